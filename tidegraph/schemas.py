"""Table contracts and the fixed word lists of the extraction."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

#: Fixed values of the extraction, as the results to match have them.
SUBJECTS = ("nsubj", "nsubjpass", "csubj", "csubjpass", "expl")
OBJECTS = ("pobj", "iobj", "dative", "attr", "dobj", "oprd", "ccomp", "xcomp", "acomp", "pcom")
VERBS = ("VERB", "AUX")
AUXILIARY = ("aux", "auxpass")
HEDGE_VERBS = ("seem", "appear", "suggest", "tend", "assume", "indicate", "doubt", "believe")
HEDGE_HELPERS = ("may", "might", "can", "could")
FUTURE_HELPERS = ("shall", "will", "wo", "'ll")
BE_FORMS = ("am", "is", "are", "'m", "'s", "'re")
NUMERIC_TYPES = ("DATE", "CARDINAL", "QUANTITY", "TIME", "MONEY", "PERCENT")
DEFAULT_TYPES = ("ORG", "GPE", "PERSON")
ROLE_STEPS, VERB_STEPS, XCOMP_STEPS = 15, 10, 4

TOKEN_COLUMNS = ("file_id", "doc_id", "sentence_id", "token_id", "token", "lemma", "pos", "tag", "head_token_id", "dep_rel", "entity")
SENTENCE = ("file_id", "doc_id", "sentence_id")


def require(df: DataFrame, columns: Iterable[str], what: str) -> None:
    """A ValueError that names the columns ``df`` lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks the columns {', '.join(missing)}")
