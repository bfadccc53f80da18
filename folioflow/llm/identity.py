"""Reading the spelled-out split, forum and venue of a case as canonical values.

Each is a column expression, and the same rule as DuckDB SQL for the checks.
Everything that says nothing (null, blank) becomes null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that name a split.
TRAIN = "(^|[^a-z])(train|training)([^a-z]|$)"
VALIDATION = "(^|[^a-z])(val|valid|validation|dev|development)([^a-z]|$)"
TEST = "(^|[^a-z])(test|testing|heldout)([^a-z]|$)"
# The decisions in which a venue id may end.
DECISIONS = "(oral|poster|spotlight|talk|accept(ed)?|reject(ed)?|withdraw(n)?|desk_?reject(ed)?)([_-](submission|paper|oral|poster|spotlight))*"
FORUM_PARAMETER = "[?&]id=([^&#]+)"
FORUM_NUMBER = "^(?i)(?:submission|paper|number|no\\.?|#)*[\\s_#:-]*0*([0-9]+)$"


def split_of(c: Column) -> Column:
    """train, validation or test; null for any other word, as for ``smoke``."""
    low = F.lower(c)
    return F.when(low.rlike(TRAIN), "train").when(low.rlike(VALIDATION), "validation").when(low.rlike(TEST), "test")


def forum_of(c: Column) -> Column:
    """The forum id out of a link, or the bare number of a numbered submission. Case is kept."""
    linked = F.regexp_extract(c, FORUM_PARAMETER, 1)
    bare = F.when(linked != "", linked).otherwise(F.regexp_replace(c, "[#?].*$", ""))
    bare = F.when(F.trim(F.regexp_replace(c, "\\s+", "")).rlike("^#[0-9]+$"), c).otherwise(bare)
    bare = F.regexp_replace(bare, "^[\\s/]+|[\\s/]+$", "")
    number = F.regexp_extract(bare, FORUM_NUMBER, 1)
    return F.nullif(F.when(number != "", number).otherwise(bare), F.lit(""))


def venue_of(c: Column) -> Column:
    """Lower case, without white space, outer slashes and the decision at the end."""
    low = F.regexp_replace(F.regexp_replace(F.lower(c), "\\s+", ""), "^/+|/+$", "")
    return F.nullif(F.regexp_replace(F.regexp_replace(low, "/+", "/"), f"(/{DECISIONS})+$", ""), F.lit(""))


SPLIT_SQL = f"CASE WHEN regexp_matches(lower({{0}}), '{TRAIN}') THEN 'train' WHEN regexp_matches(lower({{0}}), '{VALIDATION}') THEN 'validation' WHEN regexp_matches(lower({{0}}), '{TEST}') THEN 'test' END"
_BARE_SQL = f"regexp_replace(CASE WHEN regexp_extract({{0}}, '{FORUM_PARAMETER}', 1) <> '' THEN regexp_extract({{0}}, '{FORUM_PARAMETER}', 1) WHEN regexp_matches(regexp_replace({{0}}, '\\s+', '', 'g'), '^#[0-9]+$') THEN {{0}} ELSE regexp_replace({{0}}, '[#?].*$', '') END, '^[\\s/]+|[\\s/]+$', '', 'g')"
_NUMBER_SQL = f"regexp_extract({_BARE_SQL}, '(?i)^(?:submission|paper|number|no\\.?|#)*[\\s_#:-]*0*([0-9]+)$', 1)"
FORUM_SQL = f"nullif(CASE WHEN {_NUMBER_SQL} <> '' THEN {_NUMBER_SQL} ELSE {_BARE_SQL} END, '')"
VENUE_SQL = f"nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({{0}}), '\\s+', '', 'g'), '^/+|/+$', '', 'g'), '/+', '/', 'g'), '(/{DECISIONS})+$', ''), '')"
