"""Field derivations the readers share: title split, work mode, cuisine, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.text import strip, text, title_case

# Place types that say nothing about the kitchen.
GENERIC_TYPES = (
    "restaurant", "food", "point_of_interest", "establishment",
    "meal_takeaway", "meal_delivery", "store", "bar", "cafe",
)
# Map cuisine words that say nothing.
GENERIC_CUISINES = ("yes", "no", "other", "international", "regional", "traditional")


def company_colon_title(raw: Column) -> tuple[Column, Column]:
    """``Company: Title`` at the first colon, as (title, company)."""
    at = F.instr(raw, ":")
    company = F.when(at > 0, strip(F.substring(raw, F.lit(1), at - 1))).otherwise("")
    title = F.when(at > 0, strip(F.substring(raw, at + 1, F.length(raw)))).otherwise(raw)
    return title, company


def title_at_company(raw: Column) -> tuple[Column, Column]:
    """``Title at Company`` (last `` at ``), else ``Company is hiring Title``.

    The second form is recognised in lower case only; other spellings stay whole.
    """
    at = F.contains(raw, F.lit(" at "))
    tail = F.substring_index(raw, " at ", -1)
    head = F.substring(raw, F.lit(1), F.length(raw) - F.length(tail) - 4)
    hiring = F.instr(raw, " is hiring ")
    title = (
        F.when(at, strip(head))
        .when(hiring > 0, strip(F.substring(raw, hiring + 11, F.length(raw))))
        .otherwise(raw)
    )
    company = (
        F.when(at, strip(tail))
        .when(hiring > 0, strip(F.substring(raw, F.lit(1), hiring - 1)))
        .otherwise("")
    )
    return title, company


def work_mode(lowered: Column) -> Column:
    return (
        F.when(F.contains(lowered, F.lit("remote")), "remote")
        .when(F.contains(lowered, F.lit("hybrid")), "hybrid")
        .otherwise("")
    )


def work_mode_with_site(lowered: Column) -> Column:
    site = lowered.rlike("on-site|on site|onsite")
    mode = work_mode(lowered)
    return F.when((mode == "") & site, "on-site").otherwise(mode)


def cuisine_from_types(types: Column) -> Column:
    kept = F.filter(types, lambda t: ~t.isin(*GENERIC_TYPES))
    labels = F.transform(
        kept,
        lambda t: title_case(
            F.replace(F.replace(t, F.lit("_restaurant"), F.lit("")), F.lit("_"), F.lit(" "))
        ),
    )
    return F.filter(labels, lambda c: c != "")


def cuisine_from_list(raw: Column) -> Column:
    words = F.transform(F.split(text(raw), ";"), strip)
    kept = F.filter(words, lambda w: (w != "") & ~F.lower(w).isin(*GENERIC_CUISINES))
    labels = F.transform(kept, lambda w: title_case(strip(F.replace(w, F.lit("_"), F.lit(" ")))))
    return F.filter(labels, lambda c: c != "")


def neighborhood_of(components: Column) -> Column:
    """``long_name`` of the first component typed as a district or neighbourhood."""
    district = F.filter(
        components,
        lambda c: F.arrays_overlap(
            c["types"], F.array(F.lit("sublocality_level_1"), F.lit("neighborhood"))
        ),
    )
    return F.get(district, F.lit(0))["long_name"]


def round_tenth(value: Column, ties_up: bool = False) -> Column:
    """Round to one decimal on the exact binary value, ties to even (or up).

    ``round`` and ``bround`` work on the shortest decimal spelling (4.35 would go up
    although the stored double lies below 4.35).  The double next to the midpoint is
    split into two short halves, so its distance to the midpoint comes out exact.
    """
    tenths = F.floor(value * 10)
    # value * 10 itself may round up to the next integer
    tenths = F.when(tenths / F.lit(10.0) > value, tenths - 1).otherwise(tenths)
    odd = tenths * 2 + 1
    middle = odd / F.lit(20.0)
    high = F.floor(middle * (1 << 20)) / F.lit(float(1 << 20))
    error = (high * 20 - odd) + (middle - high) * 20
    up = F.when(value != middle, value > middle).otherwise(
        F.when(error != 0, error > 0).otherwise(F.lit(True) if ties_up else F.pmod(tenths, F.lit(2)) == 1)
    )
    return ((tenths + F.when(up, 1).otherwise(0)) / F.lit(10.0)).cast("double")


def halved_rating(value: Column) -> Column:
    """A ten-point rating on the five-point scale; 0 stays unknown."""
    return F.when(value != 0, round_tenth(value / 2))
