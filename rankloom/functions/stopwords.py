"""Stopword lists."""

from __future__ import annotations

# The usual English list, whose fragments (don, t, ll) are what tokenizing leaves of contractions.
ENGLISH = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her hers "
    "herself it it's its itself they them their theirs themselves what which who whom this that that'll these those am is are was were be been "
    "being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into "
    "through during before after above below to from up down in out on off over under again further then once here there when where why how all "
    "any both each few more most other some such no nor not only own same so than too very s t can will just don don't should should've now d ll "
    "m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't "
    "mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()

# Words that papers add.
EXTRA = ["et", "al", "fig", "figure", "table", "eq", "section"]

SOURCES = ("english", "custom", "none")


def word_list(values, name: str) -> list[str]:
    """Lower-cased words of a config entry; anything but a list of strings is an error."""
    if values is None:
        return []
    if not isinstance(values, (list, tuple)) or not all(isinstance(v, str) for v in values):
        raise ValueError(f"{name} must be a list of strings")
    return [v.strip().lower() for v in values if v.strip()]


def build(source: str = "english", extra=EXTRA, keep=(), custom=()) -> list[str]:
    """The list of a source, with `extra`, without `keep`, sorted. Source none is empty, whatever is added."""
    if source not in SOURCES:
        raise ValueError(f"unknown stopword source {source!r}; known: {', '.join(SOURCES)}")
    if source == "none":
        return []
    base = ENGLISH if source == "english" else word_list(custom, "custom")
    return sorted((set(base) | set(word_list(extra, "extra"))) - set(word_list(keep, "keep")))
