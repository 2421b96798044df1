"""Token counts, from the core."""

from zrno.functions.encoding import PATTERN, VOCABULARY, Sizes, count_tokens, ranks, shared_ranks, split

__all__ = ["PATTERN", "VOCABULARY", "Sizes", "count_tokens", "ranks", "shared_ranks", "split"]
