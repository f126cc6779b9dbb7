"""SQL of a command line's structural identity, for oracles: lines without quotes whose second word is the verb."""

from __future__ import annotations

from tessellar.functions import commands as C


def _map(pairs: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in pairs.items()) + "}"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in sorted(words)) + "]"


def slot_sql(t: str) -> str:
    """The slot of a token, or null."""
    shapes = " ".join(f"WHEN regexp_full_match({t}, '{'(?is)' + p.pattern}') THEN '{slot}'" for p, slot in C._SHAPES)
    return f"CASE WHEN {_map(C.LITERAL_SLOTS)}[lower({t})] IS NOT NULL THEN {_map(C.LITERAL_SLOTS)}[lower({t})] {shapes} END"


def fingerprints_sql() -> str:
    """CTEs ``fl`` (id, step, line: normalised) and ``fp`` (id, fingerprint) over ``recipes``."""
    t, before = "t[i]", "coalesce(t[i - 1], '')"
    behind = "i > 2"
    branchy = f"list_contains({_list(C.BRANCH_VERBS)}, v)"
    takes = {k: v for k, v in C.FLAG_SLOTS.items() if k != "-C"}
    hole = f"CASE WHEN {branchy} AND {behind} AND NOT list_contains({_list(C._TYPED)}, lower({t})[2:-2]) THEN '<branch>' ELSE lower({t}) END"
    flag = f"CASE WHEN contains({t}[2:], '=') THEN lower(split_part({t}, '=', 1)) || '=<' || coalesce({slot_sql(f'substr({t}, strpos({t}, chr(61)) + 1)')}, 'value') || '>' ELSE lower({t}) END"
    config = f"CASE WHEN contains({t}, '.') AND NOT contains({t}, '@') THEN lower({t}) ELSE '<' || coalesce({slot_sql(t)}, CASE WHEN ends_with(lower({before}), '.email') THEN 'email' WHEN ends_with(lower({before}), '.name') THEN 'name' ELSE 'value' END) || '>' END"
    word = f"CASE WHEN {slot_sql(t)} IS NOT NULL THEN '<' || {slot_sql(t)} || '>' WHEN {branchy} AND {behind} AND {t} <> '-' AND lower({t}) NOT IN ('head', 'origin', 'upstream') THEN '<branch>' ELSE lower({t}) END"
    one = f"CASE WHEN {_map(takes)}[{before}] IS NOT NULL THEN '<' || {_map(takes)}[{before}] || '>' WHEN regexp_full_match({t}, '<[^>]+>') THEN {hole} WHEN starts_with({t}, '-') AND {t} <> '-' THEN {flag} WHEN v = 'config' AND {behind} THEN {config} ELSE {word} END"
    return f"""ft AS (SELECT id, u.k AS step, list_filter(string_split_regex(trim(coalesce(commands[u.k].command, '')), '\\s+'), lambda x: x <> '') AS t FROM recipes, unnest(range(1, len(coalesce(commands, [])) + 1)) AS u(k)),
  fv AS (SELECT id, step, t, lower(coalesce(t[2], '')) AS v FROM ft), fw AS (SELECT id, step, t, v, w.i AS i FROM fv, unnest(range(1, len(t) + 1)) AS w(i)),
  fo AS (SELECT id, step, i, {one} AS piece FROM fw), fl AS (SELECT id, step, string_agg(piece, ' ' ORDER BY i) AS line FROM fo GROUP BY 1, 2),
  fp AS (SELECT r.id, substr(sha256(coalesce((SELECT string_agg(line, chr(10) ORDER BY step) FROM fl WHERE fl.id = r.id), '')), 1, 32) AS fingerprint FROM recipes r)"""
