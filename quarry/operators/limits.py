"""Parameter clamps. All run on the driver."""


def clamp_limit(limit: int | None) -> int:
    """A result limit: 10 if none or not positive, 100 at most."""
    return 10 if not limit or limit <= 0 else min(limit, 100)


def candidate_limit(limit: int) -> int:
    """Rows that each leg of a fused search contributes."""
    return min(3 * limit, 200)


def clamp_depth(depth: int | None) -> int:
    return 5 if not depth or depth <= 0 else min(depth, 10)


#: Symbols of a project from which a search asks for so many hits.
ADAPTIVE_K = [(15000, 25), (5000, 20), (1000, 15), (0, 10)]


def adaptive_k(symbols: int) -> int:
    return next(k for least, k in ADAPTIVE_K if symbols >= least)
