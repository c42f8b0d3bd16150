from telemap.functions.text import (
    args_of,
    base_name,
    bits_text,
    cmdline,
    gap_sign,
    host_time_text,
    hover_text,
    join_lines,
    shell_tokens,
    to_zone,
    tokenize,
    unique_label,
)

__all__ = [
    "args_of",
    "base_name",
    "bits_text",
    "cmdline",
    "gap_sign",
    "host_time_text",
    "hover_text",
    "join_lines",
    "shell_tokens",
    "to_zone",
    "tokenize",
    "unique_label",
]
