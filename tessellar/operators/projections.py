"""Shapes in which catalog rows, search results and bank records leave or enter the engine."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessellar.functions import commands as C
from tessellar.functions.text import straight_quotes, trimmed_wide



def first_words(line: Column, n: int = 2) -> Column:
    return F.array_join(F.slice(F.split(line, r"\s+"), 1, n), " ")


def result_json(status: Column, query: Column, confidence: Column, alert: Column, results: Column) -> Column:
    """SNK-17: one search as JSON with a stable set of keys, nulls written.  ``results``: array of structs.  Without a status
    it is 'ok' or 'empty' by what is shown; an empty result without an alert is 'red', any other 'none'."""
    shown = F.size(F.coalesce(results, F.array()))
    state = F.coalesce(status, F.when(shown > 0, "ok").otherwise("empty"))
    sign = F.coalesce(F.nullif(alert, F.lit("")), F.when(state == "empty", "red").otherwise("none"))
    return F.to_json(F.struct(state.alias("status"), query.alias("query"), confidence.alias("confidence"), sign.alias("alert"), F.coalesce(results, F.array()).alias("results")), {"ignoreNullFields": "false"})


def site_recipes(recipes: DataFrame) -> DataFrame:
    """SRC-16: recipes as a site shows them: ``id, title, command, primary, topic, risk, steps, step_count``; a missing title is
    the first command, a missing topic 'git', a missing risk 0, and a recipe without steps counts as one step."""
    steps = F.coalesce("commands", F.array().cast(C.STEPS))
    primary = C.primary_command(F.col("commands"))
    tidy = F.transform(steps, lambda s: F.struct(s["command"].alias("command"), F.coalesce(s["comment"], F.lit("")).alias("comment")))
    return recipes.select(
        F.coalesce(F.nullif("id", F.lit("")), primary).alias("id"),
        F.coalesce(F.nullif("title", F.lit("")), primary).alias("title"),
        first_words(primary).alias("command"),
        primary.alias("primary"),
        F.coalesce(F.nullif("taxonomy_leaf", F.lit("")), F.lit("git")).alias("topic"),
        F.coalesce("risk", F.lit(0.0)).alias("risk"),
        tidy.alias("steps"),
        F.greatest(F.size(steps), F.lit(1)).alias("step_count"),
    )


def for_tag(site: DataFrame, tag: str) -> DataFrame:
    """FLT-18: 'all', 'multi' (or 'workflow') and 'single' by number of steps, anything else a topic, case aside."""
    t = (tag or "all").lower()
    many = F.col("step_count") >= 2
    rule = {"all": F.lit(True), "multi": many, "workflow": many, "single": ~many}.get(t, F.lower("topic") == t)
    return site.filter(rule)


def usage_parts(usage: Column, example: Column) -> Column:
    """STR-14: (line, blurb) of a usage text: its first of several lines, or a line that starts with git, else the example."""
    lines = F.filter(F.transform(F.split(F.coalesce(usage, F.lit("")), "\n"), trimmed_wide), lambda x: x != "")
    fallback = F.coalesce(example, F.lit(""))
    first = F.coalesce(F.get(lines, 0), F.lit(""))
    own = (F.size(lines) >= 2) | first.rlike(r"^git(\s|$)")
    blurb = F.when(F.size(lines) >= 2, F.array_join(F.slice(lines, 2, 1 << 20), " ")).when(own, "").otherwise(first)
    return F.struct(F.when(own, first).otherwise(fallback).alias("line"), blurb.alias("blurb"))


def usage_text(line: Column, blurb: Column, example: Column) -> Column:
    """STR-14: line and blurb as one text; the example where there is no line."""
    first = F.trim(F.coalesce(F.nullif(F.trim(F.coalesce(line, F.lit(""))), F.lit("")), example, F.lit("")))
    rest = F.trim(F.coalesce(blurb, F.lit("")))
    return F.when(rest != "", F.concat(first, F.lit("\n"), rest)).otherwise(first)


def cards(site: DataFrame) -> DataFrame:
    """PRJ-15: ``id, title, topic, step_count, lines`` (a step per line, at least the primary command)."""
    lines = F.when(F.size("steps") > 0, C.snippet(F.transform("steps", lambda s: F.struct(s["command"].alias("command"), s["comment"].alias("comment"))))).otherwise(F.col("primary"))
    return site.select("id", "title", "topic", "step_count", lines.alias("lines"))


def command_anchor(command: Column, summary: Column) -> Column:
    """STR-23: the text a command's vector is made from."""
    s = F.trim(F.coalesce(summary, F.lit("")))
    return F.concat(F.lit("[command] "), command, F.when(s != "", F.concat(F.lit("\n"), s)).otherwise(""))


def search_response(status: Column, confidence: Column, shown: Column, error: Column) -> Column:
    """PRJ-13: the compact response of a search; one that failed, or gave nothing at all, has only status 'error' and a reason."""
    failed = error.isNotNull() | status.isNull()
    return F.struct(
        F.when(failed, "error").otherwise(status).alias("status"),
        F.when(~failed, confidence).alias("confidence"),
        F.when(~failed, F.size(F.coalesce(shown, F.array()))).alias("display_count"),
        F.when(failed, F.coalesce(error, F.lit("unknown"))).alias("error"),
    )


def candidates(results: Column, displayed: Column, k: int = 10) -> Column:
    """PRJ-14: the first ``k`` results, or of what was displayed where there are none."""
    return F.slice(F.when(F.size(F.coalesce(results, F.array())) > 0, results).otherwise(F.coalesce(displayed, F.array())), 1, k)


def failures(feeder: DataFrame) -> DataFrame:
    """PRJ-12: feeder rows (query, expected_id, correct_exists, ...) as failures: not hit, and without an expected id no right
    answer is claimed to exist."""
    known = F.coalesce("expected_id", F.lit("")) != ""
    return feeder.withColumn("expected_id", F.coalesce("expected_id", F.lit(""))).withColumn("correct_exists", known & F.coalesce("correct_exists", F.lit(True))).withColumn("hit", F.lit(False)).withColumn("source", F.lit("observe"))


def migrated_cases(cases: DataFrame, glossary: dict[str, str]) -> DataFrame:
    """PRJ-16: older bank records (``command``, ``example``, ``commands``, ``examples``, ``simplest``, ``prefer_simplest``) in the
    present form: commands cut to two words, examples filled in and each once, the simplest one preferred unless it says not."""
    plain = lambda c: straight_quotes(C.fill_placeholders(F.coalesce(c, F.lit("")), glossary))
    none = F.array().cast("array<string>")
    example = plain(F.coalesce(F.nullif("example", F.lit("")), F.col("command")))
    many = F.filter(F.coalesce("commands", F.array("command")), lambda c: F.coalesce(c, F.lit("")) != "")
    both = F.concat(F.coalesce("examples", none), F.coalesce("commands", none))
    return cases.withColumns({
        "command": F.when(F.col("command").contains("<"), first_words(plain(F.col("command")))).otherwise(first_words(F.col("command"))),
        "example": example,
        "commands": F.transform(many, lambda c: first_words(plain(c))),
        "examples": F.array_distinct(F.filter(F.transform(both, plain), lambda e: e != "")),
        "simplest": plain(F.coalesce(F.nullif("simplest", F.lit("")), example)),
        "prefer_simplest": F.coalesce("prefer_simplest", F.lit(True)),
    })


def json_array(raw: Column) -> Column:
    """ARR-02: a JSON array of texts; anything else is an empty one."""
    return F.coalesce(F.from_json(raw, "array<string>", {"mode": "PERMISSIVE"}), F.array().cast("array<string>"))


def verbs_json(verbs: Column) -> Column:
    """JSN-01: a list of verbs as a JSON array."""
    return F.to_json(verbs)


def verbs_of_json(raw: Column) -> Column:
    """JSN-01: back again: lower case, blank ones left out; text that is no array gives none."""
    return F.filter(F.transform(json_array(raw), lambda v: F.lower(v)), lambda v: F.coalesce(v, F.lit("")) != "")


def loose_json(text: str | None):
    """SRC-17: the first JSON value of a text that may be fenced, surrounded by prose, or cut off; None if there is none.

    The value is read with a stack of open brackets.  Where the text ends early, what stands behind the last complete
    member is dropped and the brackets are closed.
    """
    raw = text or ""
    start = min((i for i in (raw.find("{"), raw.find("[")) if i >= 0), default=-1)
    if start < 0:
        return None
    raw = raw[start:]
    try:
        return json.JSONDecoder().raw_decode(raw)[0]
    except ValueError:
        pass
    stack: list[str] = []
    whole: list[tuple[int, str]] = []  # places where the text may end, and what closes it there
    quoted = escaped = False
    for i, ch in enumerate(raw):
        if quoted:
            escaped, quoted = ch == "\\" and not escaped, ch != '"' or escaped
            continue
        if ch == '"':
            quoted = True
        elif ch in "{[":
            stack.append("}" if ch == "{" else "]")
            whole.append((i + 1, "".join(reversed(stack))))
        elif ch in "}]" and stack:
            stack.pop()
            whole.append((i + 1, "".join(reversed(stack))))
        elif ch == ",":
            whole.append((i, "".join(reversed(stack))))
    whole.append((len(raw), "".join(reversed(stack))))
    for end, closing in reversed(whole):
        try:
            return json.loads(raw[:end] + closing)
        except ValueError:
            continue
    return None


@F.pandas_udf(StringType())
def loose_json_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """SRC-17 as a column: the value as strict JSON, null if there is none."""
    for s in batches:
        found = [loose_json(t) for t in s]
        yield pd.Series([None if v is None else json.dumps(v, ensure_ascii=False) for v in found], dtype=object)
