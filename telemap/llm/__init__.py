"""Operators that prepare text for the training of language models."""


def all_registries():
    import corpus_pipeline
    from telemap.llm import queries
    from telemap.plans import Registry

    whole = Registry()
    whole.queries["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL:
        whole.sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return [queries.REGISTRY, whole]
