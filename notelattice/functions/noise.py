"""Noise words: a parameter of every operator that tokenises.

The default is the common English stop word list below and, for acronyms in capitals, the same words in
capitals plus a short list. A collection with a list of its own passes ``NoiseWords(stop, upper)`` or names
files in the settings, words separated by blanks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# The common English stop word list.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them "
    "their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing "
    "a an the and but if or because as until while of at by for with about against between into through during before after above below to from "
    "up down in out on off over under again further then once here there when where why how all any both each few more most other some such no "
    "nor not only own same so than too very s t can will just don should now d ll m o re ve y ain aren couldn didn doesn hadn hasn haven isn ma "
    "mightn mustn needn shan shouldn wasn weren won wouldn"
).split()

# Capitals that are not acronyms of a text: formats, code and units.
SKIP_UPPER = (
    "CSS DIV DOM EOF FIG GIT HEX IMG INT LOG MAX MIN MOD MUT NIL NUL OBJ OPT PNG PRE PTR RAW REF REL RES RET ROW SRC STD STR SUB SUM SVG TAB TAG "
    "TMP URL VAL VAR XML EG IE VS OK NA NB PS FYI TBD TBA WIP FAQ KB MB GB TB MS NS HZ MHZ GHZ"
).split()

#: Hex-like words: colours and short digests.
HEX_WORD = "^[0-9a-f]{3,8}$"


@dataclass(frozen=True)
class NoiseWords:
    """Words that carry no meaning for search: lower-case stop words, and capitals that are no acronyms."""

    stop: tuple[str, ...] = field(default_factory=lambda: tuple(sorted(set(STOP_WORDS))))
    upper: tuple[str, ...] = field(default_factory=lambda: tuple(sorted({w.upper() for w in STOP_WORDS} | set(SKIP_UPPER))))

    @classmethod
    def load(cls, stop_path: str, upper_path: str | None = None) -> NoiseWords:
        """Lists from files of blank-separated words."""
        read = lambda p: tuple(sorted(set(open(p, encoding="utf-8").read().split())))
        stop = read(stop_path)
        return cls(stop, read(upper_path) if upper_path else tuple(sorted(w.upper() for w in stop)))


DEFAULT = NoiseWords()


def of_settings(stop_file: str, upper_file: str = "") -> NoiseWords:
    """The lists of the files that the settings name, else the default."""
    return NoiseWords.load(stop_file, upper_file or None) if stop_file else DEFAULT
