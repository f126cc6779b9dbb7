"""Preparing banks and catalogs: acceptability, unions, taxonomy filters and patches, picks that depend on order, cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellar.functions import commands as C
from tessellar.functions.text import is_command_like, is_fallback_question, plain_query, straight_quotes, trimmed_wide
from tessellar.operators.blocks import previous, with_block
from tessellar.operators.similarity import token_links
from tessellar.operators.taxonomy import without_subtrees

#: Kinds of a bank, and the verbs that may use the template of a searched-for string.
KINDS = ["golden", "extended", "scrambled"]
SEARCH_VERBS = ["log", "grep", "blame"]


def names_verb(text: Column, tokens: Column) -> Column:
    """Whether a normalised text names one of the bare verbs as words; a dash of a verb may be a blank or nothing."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    spelled = lambda v: F.array(v, F.replace(v, F.lit("-"), F.lit(" ")), F.replace(v, F.lit("-"), F.lit("")))
    return F.exists(tokens, lambda v: F.exists(spelled(v), lambda w: F.contains(padded, F.concat(F.lit(" "), w, F.lit(" ")))))


def acceptance(rows: DataFrame, prior: DataFrame, threshold: float = 0.85) -> DataFrame:
    """FLT-08: ``rows`` (id, text, verbs: bare) against ``prior`` (text): ``id``, ``reason``, null if the text is fit.

    In order: under six characters, no verb of its recipe named, a template of searching for a string under another verb,
    equal to a prior text, or near one (Jaccard of tokens of three letters and more).  Equality is an equi-join and
    nearness a similarity join; no text meets all prior ones.
    """
    q = rows.select("id", plain_query(F.coalesce("text", F.lit(""))).alias("q"), "verbs")
    old = prior.select(plain_query(F.coalesce("text", F.lit(""))).alias("q")).filter("q <> ''").distinct()
    equal = q.join(old, "q", "left_semi").select("id", F.lit(True).alias("_equal")).distinct()
    both = q.select(F.concat(F.lit("n:"), F.col("id").cast("string")).alias("k"), F.col("q").alias("t")).unionByName(old.select(F.concat(F.lit("p:"), "q").alias("k"), F.col("q").alias("t")))
    links = token_links(both, "k", "t", threshold)
    # keys of rows sort before those of prior texts
    near = links.filter(F.col("a").startswith("n:") & F.col("b").startswith("p:")).select(F.substring("a", 3, 1 << 20).alias("_id"), F.lit(True).alias("_near")).distinct()
    j = q.join(equal, "id", "left").join(near, F.col("id").cast("string") == F.col("_id"), "left")
    template = F.contains("q", F.lit("introduced a specific string")) & ~F.arrays_overlap("verbs", F.array(*[F.lit(v) for v in SEARCH_VERBS]))
    reason = (
        F.when(F.length("q") < 6, "too_short")
        .when((F.size("verbs") > 0) & ~names_verb(F.col("q"), F.col("verbs")), "missing_verb_token")
        .when(template, "generic_template")
        .when(F.col("_equal"), "exact_dup")
        .when(F.col("_near"), "near_dup")
    )
    return j.select("id", reason.alias("reason"))


def active_bank(banks: dict[str, DataFrame], text: str, kinds: list[str] = KINDS, without_fallbacks: bool = True) -> DataFrame:
    """FLT-10: the banks of the given kinds as one, ``kind`` overwritten; fallback questions leave the first kind only."""
    out = None
    for kind in KINDS:
        if kind not in kinds or kind not in banks:
            continue
        b = banks[kind]
        if kind == KINDS[0] and without_fallbacks:
            b = b.filter(~is_fallback_question(F.col(text)))
        b = b.withColumn("kind", F.lit(kind))
        out = b if out is None else out.unionByName(b)
    if out is None:
        raise ValueError(f"no bank of the kinds {kinds}")
    return out


def evaluation_intents(intents: DataFrame, recipes: DataFrame) -> DataFrame:
    """PRJ-17, JN-16: ``intents`` (intent_id, text, recipe_id) with their recipe's first command: ``intent_id, text, recipe_id,
    example, command, topic``.  Blank and command-like texts, texts equal to that command, and rows of no known recipe are
    left out; an intent without a command of its own takes the first two words of the recipe's."""
    first = straight_quotes(C.primary_command(F.col("commands")))
    r = recipes.select(F.col("id").alias("recipe_id"), first.alias("example"), F.coalesce("taxonomy_leaf", F.lit("git")).alias("topic"))
    j = intents.select("intent_id", trimmed_wide(F.col("text")).alias("text"), "recipe_id").filter(F.coalesce("text", F.lit("")) != "").filter(~is_command_like(F.col("text"))).join(r, "recipe_id")
    j = j.filter((F.col("example") == "") | (F.lower(straight_quotes(F.col("text"))) != F.lower("example")))
    return j.select("intent_id", "text", "recipe_id", "example", F.array_join(F.slice(F.split("example", r"\s+"), 1, 2), " ").alias("command"), "topic")


def groundable(commands: DataFrame) -> DataFrame:
    """FLT-16: ``commands`` (command, available) that can be tried: not unavailable, and no check of a signed object."""
    return commands.filter(F.coalesce("available", F.lit(True)) & ~F.coalesce(F.lower("command").rlike(r"\bverify-(commit|tag)\b"), F.lit(False)))


def listed(commands: DataFrame) -> DataFrame:
    """FLT-17: trimmed commands that aren't unavailable; unknown availability counts as available."""
    return commands.filter(F.coalesce("available", F.lit(True))).select(F.trim("command").alias("command")).filter("command <> ''")


def availability(commands: DataFrame) -> DataFrame:
    """HLP-20: available, unavailable and standalone commands, and all."""
    ok = F.coalesce("available", F.lit(True))
    return commands.agg(F.count_if(ok).alias("available"), F.count_if(~ok).alias("unavailable"), F.count_if(F.col("runner") == "standalone").alias("standalone"), F.count(F.lit(1)).alias("total"))


def with_backfill(mapped: DataFrame, commands: DataFrame) -> DataFrame:
    """HLP-19: ``mapped`` (leaf, command) and a leaf of its own for every command of ``commands`` in no leaf."""
    rest = commands.select("command").distinct().join(mapped, "command", "left_anti")
    return mapped.select("leaf", "command").unionByName(rest.select(F.concat(F.lit("backfill "), "command").alias("leaf"), "command"))


def patched(nodes: DataFrame, renames: DataFrame, merges: DataFrame, most: int = 6) -> DataFrame:
    """SET-07: ``nodes`` (id, parent_id, name, commands) after ``renames`` (id, name) and ``merges`` (keep_id, drop_id, place): a
    kept node takes over, behind its own and each once, the commands of the dropped ones, up to ``most``; dropped nodes go
    with all below them."""
    given = renames.filter(F.coalesce("name", F.lit("")) != "").groupBy("id").agg(F.max("name").alias("_name"))
    taken = merges.join(nodes.select(F.col("id").alias("drop_id"), F.col("commands").alias("_c")), "drop_id")
    taken = taken.groupBy(F.col("keep_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("place", "drop_id", F.coalesce("_c", F.array().cast("array<string>")).alias("c")))).alias("_l"))
    taken = taken.select("id", F.flatten(F.transform("_l", lambda x: x["c"])).alias("_more"))
    own = F.coalesce("commands", F.array().cast("array<string>"))
    full = nodes.join(given, "id", "left").join(taken, "id", "left")
    merged = F.when(F.col("_more").isNotNull(), F.slice(F.array_distinct(F.concat(own, "_more")), 1, most)).otherwise(F.col("commands"))
    full = full.select("id", "parent_id", F.coalesce("_name", "name").alias("name"), merged.alias("commands"))
    return without_subtrees(full, merges.select(F.col("drop_id").alias("id")))


def fan_out(rows: DataFrame, parent: str, order: list[str], most: int = 8) -> DataFrame:
    """ARR-01, SRT-07: the first ``most`` children of each parent.  A top-k per group: only ranks are kept, not groups."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(parent).orderBy(*order))).filter(F.col("_n") <= most).drop("_n")


def simplicity(steps: Column) -> Column:
    """SRT-05: sorts simpler recipes first: steps, flags, words, then the canonical text."""
    words = F.transform(steps, lambda s: C.words_of(s["command"]))
    flags = F.aggregate(words, F.lit(0), lambda n, w: n + F.size(F.filter(w, lambda t: t.rlike("^--?[A-Za-z]"))))
    return F.struct(F.size(steps).alias("steps"), flags.alias("flags"), F.aggregate(words, F.lit(0), lambda n, w: n + F.size(w)).alias("words"), C.steps_json(steps).alias("text"))


def loose_fingerprint(steps: Column) -> Column:
    """DED-04: verb and sorted flags of each step, values left out."""
    def one(s: Column) -> Column:
        w = C.words_of(s["command"])
        flags = F.array_sort(F.transform(F.filter(w, lambda t: t.rlike("^--?[A-Za-z]")), lambda t: F.lower(t)))
        return F.concat(F.coalesce(F.nullif(C.verb(s["command"]), F.lit("")), F.array_join(F.slice(w, 1, 2), " ")), F.lit("|"), F.array_join(flags, ","))

    return F.array_join(F.transform(steps, one), "||")


def simplest_each(recipes: DataFrame, id_col: str, steps: str) -> DataFrame:
    """DED-04: of the recipes with one loose fingerprint the simplest (ties: smaller id), and how many there are."""
    s = F.coalesce(F.col(steps), F.array().cast(C.STEPS))
    k = recipes.filter(F.size(s) > 0).select(loose_fingerprint(s).alias("fingerprint"), F.struct(simplicity(s).alias("s"), F.col(id_col).alias("id")).alias("_o"))
    return k.groupBy("fingerprint").agg(F.min("_o").alias("_o"), F.count(F.lit(1)).alias("recipes")).select("fingerprint", F.col("_o.id").alias("id"), "recipes")


def diverse(leaves: DataFrame, fixture: str, verb: str, order: str, most: int) -> DataFrame:
    """WIN-13: ``most`` leaves in ``order``, first those whose fixture and verb are both new, then those of a new verb, then the
    rest: adds ``pick``.  The first part has one leaf a fixture at most, of which there are few: each is a single aggregate;
    the second is the first leaf of each verb left; no leaf is compared with the others."""
    row = F.min_by(F.struct(order, fixture, verb), F.col(order))
    fixtures: list = []
    verbs: list = []
    picks: list = []
    while len(picks) < most:
        left = leaves.filter(~F.coalesce(F.col(fixture), F.lit("")).isin(fixtures) & ~F.coalesce(F.col(verb), F.lit("")).isin(verbs)) if picks else leaves
        best = left.agg(row.alias("r")).first()["r"]
        if best is None:
            break
        picks.append(best[0])
        fixtures.append(best[1] or "")
        verbs.append(best[2] or "")
    # part 0: those picks; 1: the first leaf of each other verb; 2: the rest
    firsts = leaves.filter(~F.coalesce(F.col(verb), F.lit("")).isin(verbs)).groupBy(F.coalesce(F.col(verb), F.lit("")).alias("_v")).agg(F.min(order).alias(order)).select(order, F.lit(1).alias("_first"))
    early = F.lit(None).cast("int")
    for n, p in enumerate(picks):
        early = F.when(F.col(order) == F.lit(p), n).otherwise(early)
    j = leaves.withColumn("_early", early).join(firsts, order, "left")
    part = F.when(F.col("_early").isNotNull(), 0).when(F.col("_first").isNotNull(), 1).otherwise(2)
    ranked = j.withColumn("_part", part).orderBy("_part", "_early", order).limit(most)
    return ranked.withColumn("pick", F.row_number().over(Window.orderBy("_part", "_early", order))).drop("_early", "_first", "_part")


def example_mix(hits: DataFrame, kind: str, each: int = 2, total: int = 10) -> DataFrame:
    """SRT-06: of each query's ``hits`` (query_id, id, rank, ``kind``: preference) ``each`` of the nearest and as many of the
    farthest, better kinds first, filled up to ``total`` by kind and rank; adds ``part`` ('near', 'far', 'fill')."""
    w = Window.partitionBy("query_id")
    near = F.row_number().over(w.orderBy(F.desc(kind), "rank", "id"))
    h = hits.withColumn("_near", near)
    far = F.row_number().over(w.orderBy((F.col("_near") <= each).cast("int"), F.desc(kind), F.desc("rank"), F.desc("id")))
    h = h.withColumn("_far", far).withColumn("part", F.when(F.col("_near") <= each, "near").when(F.col("_far") <= each, "far").otherwise("fill"))
    order = F.when(F.col("part") == "near", 0).when(F.col("part") == "far", 1).otherwise(2)
    return h.withColumn("_o", order).withColumn("place", F.row_number().over(w.orderBy("_o", F.desc(kind), "rank", "id"))).filter(F.col("place") <= total).drop("_near", "_far", "_o")


def phase_times(marks: DataFrame, key: str, at: str, phase: str, tie: str) -> DataFrame:
    """WIN-14: time that passed up to each mark since the one before it of the same key (0 for its first), summed by phase."""
    m = previous(with_block(marks, at), key, [at, tie], [phase])
    spent = F.coalesce(F.col(at) - F.col(f"_prev.{at}"), F.lit(0))
    return m.groupBy(key, phase).agg(F.sum(spent).alias("elapsed"), F.count(F.lit(1)).alias("marks"))


def cell_states(marks: DataFrame, rows: list[str], columns: list[str], row: str, column: str, status: str) -> DataFrame:
    """HLP-15: the state of every cell of two fixed lists: 'filled' beats 'skipped' beats 'empty'; marks outside don't count."""
    spark = marks.sparkSession
    cells = spark.createDataFrame([(r, c) for r in rows for c in columns], "cell_row string, cell_column string")
    rank = F.when(F.col(status) == "filled", 2).when(F.col(status) == "skipped", 1).otherwise(0)
    best = marks.groupBy(F.col(row).alias("cell_row"), F.col(column).alias("cell_column")).agg(F.max(rank).alias("_r"))
    return cells.join(best, ["cell_row", "cell_column"], "left").select("cell_row", "cell_column", F.element_at(F.array(F.lit("empty"), F.lit("skipped"), F.lit("filled")), F.coalesce("_r", F.lit(0)) + 1).alias("state"))


def cell_totals(cells: DataFrame) -> DataFrame:
    """AGG-21, HLP-15: filled, skipped, empty and all cells, and whether all are decided."""
    n = lambda s: F.count_if(F.col("state") == s)
    return cells.agg(n("filled").alias("filled"), n("skipped").alias("skipped"), n("empty").alias("empty"), F.count(F.lit(1)).alias("total"), (n("empty") == 0).alias("all_decided"))


def id_set(values: Column) -> Column:
    """SET-06: ids to leave out, given as text of one or several: the numbers among them, each once."""
    parts = F.split(F.coalesce(values.cast("string"), F.lit("")), r"[\s,\[\]]+")
    return F.array_distinct(F.filter(F.transform(parts, lambda p: p.try_cast("bigint")), lambda n: n.isNotNull()))


def foreign_neighbours(hits: DataFrame, score: str, distance: str) -> DataFrame:
    """HLP-16: search hits as neighbours: ``id``, ``text`` ('' for none), ``similarity`` (the score, else 1 less the distance, else 0)."""
    return hits.select("query_id", "id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(score, 1 - F.col(distance), F.lit(0.0)).alias("similarity"))


def in_focus(topic: Column, command: Column, topics: list[str], commands: list[str]) -> Column:
    """HLP-24: of a preferred topic or command; either is enough where both are given, everything passes where none is."""
    t = F.lower(F.coalesce(topic, F.lit(""))).isin([x.lower() for x in topics])
    c = F.lower(straight_quotes(F.coalesce(command, F.lit("")))).isin([x.lower() for x in commands])
    return t | c if topics and commands else t if topics else c if commands else F.lit(True)


def covered_areas(cases: DataFrame) -> DataFrame:
    """AGG-24: distinct topics and commands of cases (tags, commands), sorted; tags that only mark how a case was made don't count."""
    made = F.exists(F.array(F.lit("generated")), lambda x: F.col("v") == x) | F.col("v").startswith("cycle-")
    topics = cases.select(F.explode("tags").alias("v")).filter((F.coalesce("v", F.lit("")) != "") & ~made).select(F.lit("topic").alias("area"), "v")
    commands = cases.select(F.explode("commands").alias("v")).select(straight_quotes(F.col("v")).alias("v")).filter(F.coalesce("v", F.lit("")) != "").select(F.lit("command").alias("area"), "v")
    return topics.unionByName(commands).distinct().select("area", F.col("v").alias("value"))


def pulled(events: DataFrame, ms: str, id_col: str, name: str, names: list[str], since_ms: int, page: int = 10_000) -> DataFrame:
    """SRC-11: one page of a pull: events of the given names from an instant on, in order of time and id.  The page is the
    feature (a pull takes 1 to 50,000 rows); what follows is pulled from the last instant on."""
    return events.filter((F.col(ms) >= since_ms) & F.col(name).isin(names)).orderBy(ms, id_col).limit(max(1, min(page, 50_000)))


def lookback_ms(now_ms: int, since: str | None, days: int = 7) -> int:
    """DAT-02: the instant a pull starts from: the one given in ISO form, else ``days`` before now."""
    from datetime import UTC, datetime

    try:
        at = datetime.fromisoformat((since or "").replace("Z", "+00:00"))
    except ValueError:
        return now_ms - days * 86_400_000
    return int((at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp()) * 1000


def run_stamp(at: Column) -> Column:
    """DAT-03: an instant in the name of a run's folder."""
    return F.date_format(at, "yyyy-MM-dd'T'HH-mm-ss-SSS'Z'")


def day_key(at: Column) -> Column:
    """DAT-03: the UTC day (the session's zone is UTC)."""
    return F.date_format(at, "yyyy-MM-dd")


def late_rows(deliveries: DataFrame, batch: str, ms: str) -> DataFrame:
    """STM-05: per batch its rows, and those older than the cursor, the greatest instant of all batches before it: these a
    pull would not see again.  The running maximum goes over one row a batch."""
    tops = deliveries.groupBy(batch).agg(F.max(ms).alias("_top"))
    w = Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, -1)
    cursors = tops.withColumn("cursor", F.max("_top").over(w)).select(batch, "cursor")
    return deliveries.join(cursors, batch).groupBy(batch).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(ms) < F.col("cursor")).alias("late"))
