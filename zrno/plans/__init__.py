"""Named queries over the tables."""


def all_queries() -> tuple[dict, dict]:
    """(queries, SQL) of the core."""
    from zrno.plans import character_queries, corpus_queries, ledger_queries, merge_queries, model_queries, text_queries  # noqa: F401
    from zrno.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
