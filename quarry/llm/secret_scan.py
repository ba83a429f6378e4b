"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are (1) values: what is assigned to a name that holds a word such as token or password, quoted or up to the next space,
from 4 characters on; (2) the password within a URL; (3) other runs of 12 token characters and more that hold a digit or begin like a known service's tokens. Names, "=",
":" and quotes belong to no candidate; where candidates overlap, the first kind named here stands. A forest scores each from its length,
its character transitions, the part of it that dictionary words cover, the path it may be part of, the words around it, and how it was
found. It is trained on `findings` labelled findings, drawn with a seed from the generators below: a bounded
sample, since the tables carry no such labels. The generated lines pass through the scanner itself, so the forest learns from
candidates as they are cut: those that are the line's secret are positive, all others of the line negative. The dictionary is the
letters-only pieces of a public vocabulary. Training takes the driver a few seconds; the forest is arrays of a few thousand nodes that every task gets.

Defined cases. Null and empty texts have no candidates. Candidates have no upper length. Repeated rows give repeated findings.
Offsets are in code points. Empty tables: no rows. Kept columns named like a result column give way. Very long texts: all
patterns scan in linear time.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_text, read, without

FINDINGS = 8000
SEED = 11
TREES = 40
DEPTH = 12
THRESHOLD = 0.5

#: Words that speak for a secret near it, and words that speak against one.
FOR = frozenset("token secret password passwd pwd key apikey api auth credential credentials bearer private access signature session".split())
AGAINST = frozenset("example sample dummy test fake placeholder commit sha sha1 sha256 md5 checksum digest hash id uuid guid version file path url http https isbn phone card order invoice build etag integrity".split())

#: How public services' tokens begin.
VENDORS = ("ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "sk_live_", "sk_test_", "rk_live_", "sk-", "xoxb-", "xoxp-", "xapp-", "AKIA", "ASIA", "AIza", "ya29.", "eyJ", "npm_", "hf_", "pypi-", "dop_v1_", "shpat_", "SG.")

_RUN = re.compile(r"(?<![A-Za-z0-9_\-+/.~%])[A-Za-z0-9_\-+/.~%]{12,}+(?:={1,2}(?![A-Za-z0-9_\-+/.~%]))?")
#: The end of a name with such a word, and what assigns; bounded, so a scan is linear.
_NAMED = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|passphrase|pwd|api_?-?key|apikey|access_?-?key|account_?-?key|private_?-?key|auth|credentials?|bearer|signature)[A-Za-z0-9_.\-]{0,40}[\"'`]?(?:[ \t]{0,3}(?:=>|->|:=|=|:)[ \t]{0,3}(?:(?:bearer|basic)[ \t])?|[ \t]{1,3}(?:is[ \t]{1,3})?)")
_QUOTED = {q: re.compile(rf"{q}([^{q}\n]{{4,}}+){q}") for q in "\"'`"}
_BARE = re.compile(r"[^\s\"'`,;<>(){}\[\]]{4,}+")
_URL = re.compile(r"://[^\s/:@\"']*+:([^\s/@\"']{3,}+)@")
_BEFORE = re.compile(r"[A-Za-z0-9]+")
_UUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I)
_REFERENCE = re.compile(r"[$%]?[\[{(<].*|\$\w+|[A-Za-z_]\w*(?:(?:\.|::|->)[A-Za-z_]\w*)+(?:\(.*)?", re.S)

NAMED, URL, RUN = 2, 1, 0
FEATURES = ["length", "entropy", "digits", "uppers", "lowers", "marks", "transitions", "hex", "uuid", "vowels", "bigram", "covered", "longest", "slashes", "dots", "after_path", "extension", "for_near", "against_near", "assigned", "quoted", "repeats", "kind", "vendor", "jwt", "spaces", "reference", "kinds", "end_mark"]


def _classes(s: str) -> list[int]:
    return [0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in s]


def dictionary(path: str) -> frozenset[str]:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    words = (sp.id_to_piece(i).lstrip("▁").lower() for i in range(sp.get_piece_size()))
    return frozenset(w for w in words if 4 <= len(w) <= 16 and w.isascii() and w.isalpha())


def bigrams_of(words: frozenset[str]) -> dict[str, float]:
    """Log-probability of a letter after another in the dictionary, with add-one smoothing."""
    n = np.ones((26, 26))
    for w in words:
        for a, b in zip(w, w[1:]):
            n[ord(a) - 97, ord(b) - 97] += 1
    p = np.log(n / n.sum(1, keepdims=True))
    return {chr(97 + i) + chr(97 + j): float(p[i, j]) for i in range(26) for j in range(26)}


def covered(s: str, words: frozenset[str]) -> tuple[float, int]:
    """The part of s that dictionary words cover, longest first from the left, and the longest such word."""
    low, at, total, longest = s.lower(), 0, 0, 0
    while at < len(low):
        for n in range(min(16, len(low) - at), 3, -1):
            if low[at : at + n] in words:
                total, longest, at = total + n, max(longest, n), at + n
                break
        else:
            at += 1
    return total / max(len(s), 1), longest


def features(text: str, start: int, end: int, kind: int, words: frozenset[str], bigrams: dict[str, float]) -> list[float]:
    s = text[start:end]
    n, k = len(s), _classes(s)
    before = text[max(0, start - 48) : start]
    near = {w.lower() for x in _BEFORE.findall(before)[-4:] for w in x.split("_")} | {w.lower() for w in _BEFORE.findall(text[end : end + 24])[:2]}
    pairs = [bigrams[x] for x in (s[i : i + 2].lower() for i in range(n - 1)) if x in bigrams]
    counts = [c / n for c in Counter(s).values()]
    cover, longest = covered(s, words)
    letters = sum(x in (1, 2) for x in k)
    lead = before.rstrip("\"'` \t")
    return [
        n, -sum(c * math.log2(c) for c in counts), k.count(0) / n, k.count(2) / n, k.count(1) / n, k.count(3) / n,
        sum(a != b for a, b in zip(k, k[1:])) / max(n - 1, 1), all(c in "0123456789abcdefABCDEF" for c in s), bool(_UUID.fullmatch(s)),
        sum(c in "aeiouAEIOU" for c in s) / max(letters, 1), sum(pairs) / len(pairs) if pairs else -4.0, cover, longest,
        s.count("/"), s.count("."), before.endswith(("/", "\\", "://", "@")), bool(re.search(r"\.[A-Za-z]{1,4}$", s[-8:])),
        len(near & FOR), len(near & AGAINST), lead.endswith(("=", ":", ">")), before.endswith(('"', "'", "`")), max(counts),
        kind, s.startswith(VENDORS), s.startswith("eyJ") and s.count(".") == 2, s.count(" ") / n, bool(_REFERENCE.fullmatch(s[:200])), len(set(k)), s[-1] in ".,:!?",
    ]


def candidates(text: str | None) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the candidates of a whole text, in order, without overlaps."""
    if not text:
        return []
    found: list[tuple[int, int, int]] = []
    for m in _NAMED.finditer(text):
        at = m.end()
        if found and m.start() < found[-1][1]:  # within a value: else a run of names would be scanned again and again
            continue
        sure = any(c in "=:>" for c in m[0])  # after a space alone, a value must hold a digit
        quote = _QUOTED.get(text[at : at + 1])
        v = quote.match(text, at) if quote else _BARE.match(text, at)
        if v:
            a, b = v.span(1) if quote else v.span()
            if not quote:
                b -= len(v[0]) - len(v[0].rstrip(".,:!?"))
            if b - a >= 4 and (sure or any(c.isdigit() for c in text[a:b])):
                found.append((a, b, NAMED))
    found += [(*m.span(1), URL) for m in _URL.finditer(text)]
    for m in _RUN.finditer(text):
        core = m[0].strip(".-/~%+_") if m[0][-1] != "=" else m[0].lstrip(".-/~%+_")
        if len(core) >= 12 and (core.startswith(VENDORS) or any(c.isdigit() for c in core)):
            a = m.start() + m[0].index(core)
            found.append((a, a + len(core), RUN))
    found.sort(key=lambda x: (x[0], -x[2]))
    out: list[tuple[int, int, int]] = []
    for x in found:
        while out and x[0] < out[-1][1] and x[2] > out[-1][2]:
            out.pop()
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


def labelled_lines(seed: int, words: frozenset[str]):
    """Endless (text, start, end) lines, every other one with a secret at start to end; start is -1 without one."""
    r = random.Random(seed)
    lexicon = sorted(words)
    hexa, alnum, digits = "0123456789abcdef", string.ascii_letters + string.digits, string.digits
    b64, symbols = alnum + "+/", alnum + "!@#$%^&*-_+?"
    keys = ["token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "api-key", "auth_token", "access_token", "access_key", "client_secret", "private_key", "credential", "db_password", "passphrase", "bearer", "signature"]

    def pick(chars: str, lo: int, hi: int) -> str:
        return "".join(r.choice(chars) for _ in range(r.randint(lo, hi)))

    def prose(k: int) -> str:
        return " ".join(r.choice(lexicon) for _ in range(k))

    def name() -> str:
        n = r.choice(keys)
        n = r.choice([n, n, n.upper(), "app_" + n, "my" + n.capitalize(), n + "_" + r.choice(["prod", "1", "main", "v2"]), r.choice(lexicon) + "_" + n])
        return n

    def short() -> str:
        """A password that people make."""
        w = r.choice(lexicon)
        return r.choice([lambda: w + pick(digits, 1, 4), lambda: w.capitalize() + pick(digits, 2, 4) + r.choice("!@#$"), lambda: pick(symbols, 8, 20), lambda: w[:5] + r.choice("@!#_-") + r.choice(lexicon)[:6] + pick(digits, 1, 4), lambda: w.replace("a", "4").replace("e", "3").replace("o", "0") + pick(digits, 1, 3), lambda: r.choice(["", "-", "_"]).join(r.choice(lexicon) for _ in range(4))])()

    def key() -> str:
        return r.choice([lambda: pick(hexa, 32, 32), lambda: pick(hexa, 40, 40), lambda: pick(hexa, 64, 64), lambda: pick(b64, 24, 64) + r.choice(["", "=", "=="]), lambda: pick(alnum, 16, 48), lambda: pick(alnum + "-_", 16, 44), lambda: pick(b64, 86, 86) + "=="])()

    def vendor() -> str:
        return r.choice([lambda: r.choice(["ghp_", "gho_", "glpat-", "npm_", "hf_", "shpat_"]) + pick(alnum, 20, 40), lambda: r.choice(["sk_live_", "rk_live_", "sk-"]) + pick(alnum, 20, 48), lambda: "AKIA" + pick(string.ascii_uppercase + "234567", 16, 16), lambda: "AIza" + pick(alnum + "-_", 35, 35), lambda: "xoxb-" + pick(digits, 11, 12) + "-" + pick(alnum, 24, 24), lambda: "eyJ" + pick(alnum, 17, 33) + ".eyJ" + pick(alnum, 30, 90) + "." + pick(alnum + "-_", 43, 43)])()

    def secret() -> tuple[str, str, str]:
        v = r.choice([key, key, vendor, short])()
        lead, tail = r.choice([
            ('{n} = "', '"'), ("{n}='", "'"), ("{n}=", ""), ("{n}: ", ""), ('"{n}": "', '"'), ("export {n}=", ""), ("export {n}='", "'"), ("{n} is ", ""), ("{n} -> ", ""), ("--{n}=", ""), ("{n}:", ""), ('{n} := "', '"'), ("?{n}=", ""), ("{n} => '", "'"),
        ])
        lead = lead.format(n=name())
        if v[-1] in ".,:!?" and not tail:
            v = v[:-1] + "7"
        return r.choice([
            lambda: (lead, v, tail), lambda: (lead, v, tail), lambda: (lead, v, tail),
            lambda: (prose(r.randint(0, 2)) + " ", vendor(), ""),
            lambda: ("Authorization: Bearer ", r.choice([key, vendor])(), ""),
            lambda: (r.choice(["postgres", "mysql", "amqp", "https", "redis", "mongodb"]) + "://" + r.choice([r.choice(lexicon), "admin", "root", ""]) + ":", r.choice([short, key])().replace("/", "x").replace("@", "x").replace(":", "x"), "@" + r.choice(["localhost", "db.example.com", "10.0.0.5"]) + ":5432/" + r.choice(lexicon)),
        ])()

    def harmless() -> str:
        w = r.choice(lexicon)
        return r.choice([
            lambda: r.choice(["commit ", "sha256: ", "md5 ", "etag: ", "checksum=", "build ", "rev ", "sha256:", "digest="]) + pick(hexa, 32, 64),
            lambda: r.choice(["id: ", "uuid = ", "request ", "id=", "session "]) + "-".join(pick(hexa, k, k) for k in (8, 4, 4, 4, 12)),
            lambda: r.choice(["see ", "path ", "https://", "file /", "open ./", "url "]) + "/".join(r.choice(lexicon) for _ in range(r.randint(2, 5))) + r.choice(["", "/v2", ".py", "-3.11.tar", "/2021/07", "/" + pick(hexa, 12, 40)]),
            lambda: r.choice(["call ", "order ", "card ", "isbn ", "at ", "phone ", prose(1) + " ", "\n"]) + pick(digits, 12, 19),
            lambda: name() + r.choice(["=", ": ", ' = "']) + r.choice(["your_{a}_here_1", "changeme", "changeme_{a}_1", "example-{a}-123", "xxxxxxxxxxxx", "****", "********", "<your-{a}>", "{a}_{b}_placeholder2", "{a}_0000000000", "REPLACE_ME", "dummy", "test1234", "TODO", "...."]).format(a=w, b=r.choice(lexicon)),
            lambda: name() + r.choice([": ", " = ", "=", " is "]) + r.choice(["required", "string", "str", "None", "null", "true", "optional", "invalid", "expired", "missing", "bytes32", "varchar255", "base64", "sha256", "utf8mb4", "{a}", "{a} {b}"]).format(a=w, b=r.choice(lexicon)),
            lambda: name() + r.choice([": ", " = ", "="]) + r.choice(["os.environ[\"{u}1\"]", "${u}", "${{{u}_2}}", "self.{a}.{b}", "get_{a}2()", "config.{a}_{b}1", "request.headers[0]", "{a}->{b}2", "{{{{ {a}.{b}1 }}}}", "process.env.{u}", "%({a})s", "<{a}1>"]).format(a=w, b=r.choice(lexicon), u=w.upper()),
            lambda: name() + r.choice([": \"", " = '", ': "']) + prose(r.randint(2, 7)) + r.choice([" 8 ", " "]) + prose(r.randint(1, 3)) + r.choice(["\"", "'"]),
            lambda: prose(2) + " " + w + r.choice("_-.") + r.choice(lexicon) + r.choice("_-.") + r.choice(lexicon) + pick(digits, 1, 3),
            lambda: "version " + ".".join(pick(digits, 1, 4) for _ in range(5)) + "-" + w,
            lambda: r.choice(["ip ", "at ", "host "]) + ".".join(str(r.randint(100, 255)) for _ in range(4)) + r.choice([":8080", ""]),
            lambda: prose(1) + " " + pick(digits, 4, 4) + "-" + pick(digits, 2, 2) + "-" + pick(digits, 2, 2) + "T" + pick(digits, 6, 6),
            lambda: w + "." + pick(digits, 2, 2) + "@mail" + pick(digits, 1, 1) + "." + r.choice(lexicon) + ".com",
            lambda: f"https://{w}.example.com:{pick(digits, 4, 4)}/{r.choice(lexicon)}@{pick(digits, 1, 2)}.{pick(digits, 1, 2)}",
            lambda: r.choice(["the ", "a ", "no ", ""]) + r.choice(["token ", "secret ", "password ", "signature "]) + prose(3) + " " + pick(digits, 1, 4),
            lambda: "data:image/png;base64," + pick(b64, 60, 300),
            lambda: r.choice(["integrity=\"sha384-", "integrity: sha512-"]) + pick(b64, 64, 86) + "==",
        ])()

    i = 0
    while True:
        i += 1
        head = prose(r.randint(0, 5)) + r.choice([" ", "\n", ". ", "\n  "])
        after = r.choice(["", *(x + prose(r.randint(0, 4)) for x in (" ", "\n", ", ", ";\n"))])
        if i % 2:
            lead, value, tail = secret()
            yield head + lead + value + tail + after, len(head + lead), len(head + lead + value)
        else:
            yield head + harmless() + after, -1, -1


def labelled_findings(n: int, seed: int, words: frozenset[str]) -> list[tuple[str, int, int, int, int]]:
    """(text, start, end, kind, is a secret) of n candidates that the scanner finds in generated lines."""
    out: list[tuple[str, int, int, int, int]] = []
    for text, start, end in labelled_lines(seed, words):
        out += [(text, *c, int(c[:2] == (start, end))) for c in candidates(text)]
        if len(out) >= n:
            return out[:n]
    raise AssertionError


class Forest:
    """Trees as arrays: feature (-1 at a leaf), threshold, left child (the right one follows it), value."""

    def __init__(self, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        self.trees = trees

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, left, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                (go,) = np.nonzero(f >= 0)
                if not len(go):
                    break
                at[go] = left[at[go]] + (x[go, f[go]] > threshold[at[go]])
            total += value[at]
        return total / max(len(self.trees), 1)


def fit_forest(x: np.ndarray, y: np.ndarray, *, trees: int = TREES, depth: int = DEPTH, seed: int = SEED, cuts: int = 24, least: int = 4) -> Forest:
    """Bagged trees; each node looks at a random square root of the features and splits where Gini impurity falls most."""
    rng = np.random.default_rng(seed)
    some = max(1, round(math.sqrt(x.shape[1])))
    out = []
    for _ in range(trees):
        nodes: list[list] = [[-1, 0.0, 0, 0.0]]
        work = [(0, rng.integers(0, len(x), len(x)), 0)]
        while work:
            at, rows, level = work.pop()
            label = y[rows]
            nodes[at][3] = float(label.mean())
            if level == depth or len(rows) < 2 * least or label.min() == label.max():
                continue
            best = (1e-9, -1, 0.0)
            parent = label.mean() * (1 - label.mean())
            for f in rng.choice(x.shape[1], some, replace=False):
                v = x[rows, f]
                grid = np.unique(np.quantile(v, np.linspace(0.02, 0.98, cuts)))
                right = v[:, None] > grid
                nr = right.sum(0)
                nl = len(rows) - nr
                sr = (right & (label[:, None] > 0)).sum(0)
                sl = label.sum() - sr
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = parent - (sl / nl * (1 - sl / nl) * nl + sr / nr * (1 - sr / nr) * nr) / len(rows)
                gain = np.where((nl >= least) & (nr >= least), gain, -1.0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), int(f), float(grid[k]))
            if best[1] < 0:
                continue
            k = len(nodes)
            nodes += [[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]]
            nodes[at][:3] = [best[1], best[2], k]
            over = x[rows, best[1]] > best[2]
            work += [(k, rows[~over], level + 1), (k + 1, rows[over], level + 1)]
        cols = list(zip(*nodes))
        out.append((np.array(cols[0], np.int64), np.array(cols[1]), np.array(cols[2], np.int64), np.array(cols[3])))
    return Forest(out)


class Detector:
    def __init__(self, forest: Forest, words: frozenset[str]):
        self.forest, self.words, self.bigrams = forest, words, bigrams_of(words)

    def matrix(self, found: list[tuple[str, int, int, int]]) -> np.ndarray:
        return np.array([features(*f, self.words, self.bigrams) for f in found], float).reshape(-1, len(FEATURES))


def train(path: str, *, findings: int = FINDINGS, seed: int = SEED, trees: int = TREES, depth: int = DEPTH) -> Detector:
    words = dictionary(path)
    data = labelled_findings(findings, seed, words)
    d = Detector(Forest([]), words)
    d.forest = fit_forest(d.matrix([x[:4] for x in data]), np.array([x[4] for x in data]), trees=trees, depth=depth, seed=seed)
    return d


def scan(docs: DataFrame, detector: Detector, *, text_col: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """A row for each finding at `threshold` or more: docs' columns `keep` (all by default), start, end, score."""
    shared = docs.sparkSession.sparkContext.broadcast(detector)

    def kernel():
        d = shared.value

        def run(texts):
            spans = [candidates(t) for t in texts]
            flat = [(t, *c) for t, x in zip(texts, spans) for c in x]
            scores = d.forest.predict(d.matrix(flat)).tolist() if flat else []
            out, k = [], 0
            for x in spans:
                out.append([{"start": a, "end": b, "score": s} for (a, b, _), s in zip(x, scores[k : k + len(x)]) if s >= threshold])
                k += len(x)
            return [out]

        return run

    keep = without(docs.columns if keep is None else keep, ["start", "end", "score", "quarry_found"])
    found = per_text(docs, text_col, "quarry_found array<struct<start:int,end:int,score:double>>", kernel, keep)
    return found.select(*keep, F.explode("quarry_found").alias("f")).select(*keep, "f.start", "f.end", "f.score")


def query(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    return scan(read(spark, sf_dir, "documents"), train(public_tokenizers.path("piece_bpe_32k.model")), keep=["doc_id"])
