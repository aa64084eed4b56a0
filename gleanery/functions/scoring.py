"""Relevance score: additive rules as one column expression, no Python on the way.

All rules but the one on age depend on the row and the preferences alone. Their sum is the
*base score*; stored next to a key of the preferences it was made with, it lets a later run
add the points for age and leave the texts alone.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.dates import age_in_days, with_wall_clock
from gleanery.functions.matching import contains_text, contains_word, haystack, joined
from gleanery.functions.text import text
from gleanery.settings import Preferences, Run

# Words that mark contract work, also inside longer words.
CONTRACT_WORDS = ("fractional", "interim", "contract", "freelance", "part-time", "part time")

# Points per signal.
STRONG_TITLE, STRONG_TEXT = 30, 15
GOOD_TITLE, GOOD_TEXT = 12, 5
AVOID = -40
PLACE_PRIORITY, PLACE_ACCEPTABLE = 20, 8
MODE_PREFERRED, MODE_MENTIONED = 10, 5
AGE_POINTS = ((2, 8), (7, 4))
STALE_AFTER, STALE = 30, -5
CONTRACT = 6


def _points(*rules: tuple[Column, int]) -> Column:
    """Points of the first rule that holds, else 0."""
    (condition, value), *rest = rules
    chain = F.when(condition, value)
    for condition, value in rest:
        chain = chain.when(condition, value)
    return chain.otherwise(0)


def preference_key(prefs: Preferences) -> str:
    """Equal for preferences that give every row the same base score."""
    rules = (
        prefs.strong, prefs.good, prefs.avoid, prefs.priority_places, prefs.acceptable_places, prefs.preferred_modes,
        prefs.contract_types, prefs.feedback, CONTRACT_WORDS, STRONG_TITLE, STRONG_TEXT, GOOD_TITLE, GOOD_TEXT, AVOID,
        PLACE_PRIORITY, PLACE_ACCEPTABLE, MODE_PREFERRED, MODE_MENTIONED, CONTRACT,
    )
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def _searched(df: DataFrame, needed: Column | None = None) -> DataFrame:
    """Add the texts that rules look into, only where they are ``needed``."""
    texts = {
        "_title": F.lower(text(F.col("title"))),
        "_text": haystack(
            F.col("title"), F.col("company"), F.col("description"), F.col("location"),
            joined(F.col("tags")),
        ),
    }
    return df.withColumns(texts if needed is None else {k: F.when(needed, v) for k, v in texts.items()})


def score(df: DataFrame, prefs: Preferences, run: Run, name: str = "score") -> DataFrame:
    """Add the relevance score.  The search text is built once per row and dropped."""
    if "posted_ts" not in df.columns:
        dated = with_wall_clock(df, "posted_date", "posted_ts", run.day)
        return score(dated, prefs, run, name).drop("posted_ts")
    total = base_points(prefs) + age_points(run)
    return _searched(df).withColumn(name, total.cast("int")).drop("_title", "_text")


def score_base(df: DataFrame, prefs: Preferences) -> DataFrame:
    """Add ``base_score`` and ``scored_by``, the key of the preferences it was made with."""
    based = _searched(df).withColumn("base_score", base_points(prefs).cast("int")).drop("_title", "_text")
    return based.withColumn("scored_by", F.lit(preference_key(prefs)))


def score_stored(df: DataFrame, prefs: Preferences, run: Run, current: bool = False) -> DataFrame:
    """Replace ``score`` by the stored base score and today's points for age.

    Rows with a base score of other preferences, or none, get a new one; only their texts are
    looked into. ``current`` says that there are no such rows: then no rule on texts is planned.
    """
    if not current:
        key = preference_key(prefs)
        stale = ~F.col("scored_by").eqNullSafe(F.lit(key))
        anew = F.when(stale, base_points(prefs).cast("int")).otherwise(F.col("base_score"))
        df = _searched(df, stale).withColumn("base_score", anew).drop("_title", "_text").withColumn("scored_by", F.lit(key))
    return df.withColumn("score", (F.col("base_score") + age_points(run)).cast("int"))


def age_points(run: Run) -> Column:
    age = age_in_days(F.col("posted_ts"), run.at)
    return _points(*[(age <= days, value) for days, value in AGE_POINTS], (age > STALE_AFTER, STALE))


def base_points(prefs: Preferences) -> Column:
    """All points but those for age, from the columns of ``_searched``."""
    title, body = F.col("_title"), F.col("_text")
    mode = F.lower(text(F.col("remote_type")))
    modes = [m.lower() for m in prefs.preferred_modes]
    terms = [
        _points(
            (contains_word(title, prefs.strong), STRONG_TITLE),
            (contains_word(body, prefs.strong), STRONG_TEXT),
        ),
        _points(
            (contains_word(title, prefs.good), GOOD_TITLE),
            (contains_word(body, prefs.good), GOOD_TEXT),
        ),
        _points((contains_word(title, prefs.avoid), AVOID)),
        _points(
            (contains_word(body, prefs.priority_places), PLACE_PRIORITY),
            (contains_word(body, prefs.acceptable_places), PLACE_ACCEPTABLE),
        ),
    ]
    if modes:
        rules = [((mode != "") & mode.isin(*modes), MODE_PREFERRED)]
        if "remote" in prefs.preferred_modes:
            rules.append((F.contains(body, F.lit("remote")), MODE_MENTIONED))
        terms.append(_points(*rules))
    wanted = {c.lower() for c in prefs.contract_types}
    if wanted & set(CONTRACT_WORDS):
        terms.append(_points((contains_text(body, CONTRACT_WORDS), CONTRACT)))
    learned = prefs.feedback
    terms += [
        _points((contains_word(title, [word]), -learned.title_keyword_penalty))
        for word in learned.title_keywords
    ]
    company = F.lower(text(F.col("company")))
    terms += [
        _points((F.contains(company, F.lit(name.lower().strip())), -learned.company_penalty))
        for name in learned.companies
        if name.strip()
    ]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


