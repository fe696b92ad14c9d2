"""Invented sentences for the fixtures."""

WORDS = ("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega "
         "river stone cloud winter summer light garden window mountain letter market harbour").split()


def prose(seed: int, n: int) -> str:
    """Invented sentences of n words."""
    out, x = [], seed * 7919 + 13
    for i in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + ("." if i % 9 == 8 else ""))
    return " ".join(out)
