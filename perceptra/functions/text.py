"""Column functions over names and replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Openings of replies that become "You see".
OPENINGS = (
    "the most interesting aspect of this series of images is",
    "the most interesting aspect of the series of images is",
    "the most interesting aspect of the images is",
    "the most interesting aspect of these images is",
    "the most interesting aspect of the video is",
)


def display_name(status: Column, name: Column, sim: Column, guess: Column, guess_sim: Column) -> Column:
    """``name (0.72)`` when identified, ``name? (0.62)`` while identifying with a guess, else ``unknown``."""
    return (
        F.when((status == "identified") & name.isNotNull(), F.format_string("%s (%.2f)", name, sim))
        .when((status == "identifying") & guess.isNotNull(), F.format_string("%s? (%.2f)", guess, guess_sim))
        .otherwise("unknown")
    )


def strip_score(shown: Column) -> Column:
    """The name of a display name: cut at the first ``? (``, else the first `` (``, if not at the start."""
    guess, sure = F.instr(shown, "? ("), F.instr(shown, " (")
    return F.when(guess > 1, F.substring(shown, F.lit(1), guess - 1)).when(
        sure > 1, F.substring(shown, F.lit(1), sure - 1)
    ).otherwise(shown)


def clean_reply(reply: Column) -> Column:
    """Lower case, with the stock openings as ``You see``."""
    out = F.lower(reply)
    for opening in OPENINGS:
        out = F.replace(out, F.lit(opening), F.lit("You see"))
    return out


def preview(text: Column, most: int = 200) -> Column:
    """The text, or its two ends about ``...`` when it is longer than ``most`` (42 or more)."""
    if most < 42:
        raise ValueError("most must be 42 or more")
    part = most // 2 - 20
    return F.when(F.length(text) <= most, text).otherwise(
        F.concat(F.substring(text, 1, part), F.lit("..."), F.substring(text, -part, part))
    )


def hit_or_miss(answer: Column) -> Column:
    return F.when(answer.isNull() | (answer == ""), "MISS").otherwise("HIT")
