"""Text and JSON functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keyword groups of the rule score and the weights of its features.
KEYWORDS = {
    "self_verification": ["check", "verify"],
    "exploratory": ["perhaps", "might"],
    "adaptive": ["therefore", "since"],
}
WEIGHTS = {"elaborated": 0.30, "self_verification": 0.20, "exploratory": 0.25, "adaptive": 0.25}
WORD = r"[\p{L}\p{N}_]+"


def norm(text: Column) -> Column:
    """Trimmed, inner blanks as one space, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def parse_level(text: Column) -> Column:
    """The digit of ``Level d``; null for anything else."""
    return F.nullif(F.regexp_extract(text, r"^\s*Level\s+(\d)\s*$", 1), F.lit("")).cast("int")


def gsm_gold(solution: Column) -> Column:
    """What follows the last ``####``, without commas; null without the mark or a rest."""
    rest = F.replace(F.trim(F.substring_index(solution, "####", -1)), F.lit(","), F.lit(""))
    return F.when(F.contains(solution, F.lit("####")), F.nullif(rest, F.lit("")))


def words(text: Column) -> Column:
    """Lower-cased words of letters, digits and underscores of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def features(text: Column, keywords: dict[str, list[str]] = KEYWORDS) -> dict[str, Column]:
    """Number of words, and the share of each keyword group among them (0 for a wordless text)."""
    return word_features(words(F.coalesce(text, F.lit(""))), keywords)


def word_features(found: Column, keywords: dict[str, list[str]] = KEYWORDS) -> dict[str, Column]:
    """The same from the words of a text."""
    n = F.size(found)
    share = lambda group: F.size(F.filter(found, lambda w: w.isin(group))) / F.nullif(n, F.lit(0))
    return {"n_words": n, **{name: F.coalesce(share(group), F.lit(0.0)) for name, group in keywords.items()}}


def repeat_share(text: Column, least_chars: int = 12, least_lines: int = 4) -> Column:
    """Share of repeated lines among those of at least ``least_chars``; 0 with fewer than ``least_lines``."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), lambda s: F.length(s) >= least_chars)
    n = F.size(lines)
    return F.when(n < least_lines, 0.0).otherwise(1 - F.size(F.array_distinct(lines)) / F.nullif(n, F.lit(0)))


def control_chars(text: Column) -> Column:
    """Number of control characters other than line feeds."""
    return F.length(text) - F.length(F.regexp_replace(text, r"[\x00-\x09\x0B-\x1F\x7F]", ""))


# The first letter that a control character ate of a command, and what is left of such commands.
EATEN = {
    "\t": ("t", "frac imes ext extbf extit heta an riangle o au ilde binom herefore op"),
    "\x0c": ("f", "rac lat orall"),
    "\x08": ("b", "inom eta oxed ar egin ullet mod igl igr ot f"),
    "\r": ("r", "ight ho angle floor ceil m"),
    "\x0b": ("v", "ec arphi arepsilon dots"),
    "\x07": ("a", "lpha ngle pprox st cute"),
    "\n": ("n", "eq eg abla otin leq geq mid ewline parallel"),
}


def repair_latex(text: Column) -> Column:
    """Restores commands that lost backslash and first letter to a control character."""
    for control, (letter, rests) in EATEN.items():
        longest_first = sorted(rests.split(), key=len, reverse=True)
        text = F.regexp_replace(text, f"{control}({'|'.join(longest_first)})(?![A-Za-z])", rf"\\{letter}$1")
    return text


def clean_gold(value: Column) -> Column:
    """Trimmed; a whole number without its ``.0``, degree signs and enclosing dollars removed."""
    plain = F.regexp_replace(F.trim(value), r"\^\s*\{?\s*\\circ\s*\}?|°", "")
    plain = F.regexp_replace(F.trim(plain), r"^\$+|\$+$", "")
    return F.regexp_replace(F.trim(plain), r"^(-?\d+)\.0+$", "$1")


def repair_json_escapes(text: Column) -> Column:
    """Doubles every backslash that begins no JSON escape (fixed values: the escapes of JSON)."""
    return F.regexp_replace(text, r'\\(?!["\\/bfnrtu])', r"\\\\")


JUDGE = "overall_score string, overall_reason string, dimensional_evaluation map<string, struct<score: string>>"
_LENIENT = {"allowUnquotedControlChars": "true", "allowBackslashEscapingAnyCharacter": "true"}


def judge_score(raw: Column) -> Column:
    """Struct ``score`` and ``how`` of a judge's answer; both null where no score can be had.

    Fences and text around the braces are dropped and odd escapes repaired; a broken
    object still gives the number after ``overall_score``, or the mean of at least
    three dimension scores.  Scores outside [0, 1] give null.
    """
    body = F.regexp_replace(F.trim(raw), r"^```(?:json)?\s*|\s*```$", "")
    braces = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    parsed = F.coalesce(
        *[
            F.from_json(part, JUDGE, _LENIENT)["overall_score"]
            for part in (body, braces, repair_json_escapes(body), repair_json_escapes(braces))
        ]
    )
    # How the two kinds of score are written.
    direct = F.nullif(F.regexp_extract(body, r'"overall_score"\s*:\s*([01](?:\.\d+)?)', 1), F.lit(""))
    parts = F.transform(
        F.regexp_extract_all(body, F.lit(r'"score"\s*:\s*([01](?:\.\d+)?)'), F.lit(1)), lambda x: x.cast("double")
    )
    mean = F.aggregate(parts, F.lit(0.0), lambda a, b: a + b) / F.nullif(F.size(parts), F.lit(0))
    enough = F.size(parts) >= 3
    score = F.coalesce(parsed.try_cast("double"), direct.try_cast("double"), F.when(enough, mean))
    how = (
        F.when(parsed.try_cast("double").isNotNull(), "json")
        .when(direct.isNotNull(), "regex_overall")
        .when(enough, F.concat(F.lit("mean_of_"), F.size(parts).cast("string"), F.lit("_dimensions")))
    )
    valid = score.between(0.0, 1.0)
    return F.struct(F.when(valid, score).alias("score"), F.when(valid, how).alias("how"))
