from telemap.sources.stages import (
    load_dictionary,
    load_stage,
    load_triples,
    load_vectors,
    read_source,
    register_views,
    save_dictionary,
    save_stage,
    save_triples,
    save_vectors,
)

__all__ = [
    "load_dictionary",
    "load_stage",
    "load_triples",
    "load_vectors",
    "read_source",
    "register_views",
    "save_dictionary",
    "save_stage",
    "save_triples",
    "save_vectors",
]
