"""SQL text fragments shared by the oracle queries (DuckDB dialect)."""

from __future__ import annotations

from .. import fixed_values as fv
from ..functions.text import UNICODE_SPACE_CLASS


def q(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{UNICODE_SPACE_CLASS}+|{UNICODE_SPACE_CLASS}+$', '', 'g')"


def has_letter(expr: str) -> str:
    return f"regexp_matches({expr}, '[a-zA-Z]')"


def ref(name: str, ident: str) -> str:
    return f"(coalesce({name}, '') || ' (' || coalesce({ident}, 'N/A') || ')')"


def is_chemical(expr: str) -> str:
    stems = ", ".join(q(s) for s in fv.CHEMICAL_STEMS)
    return f"(len(list_filter([{stems}], lambda stem: contains(lower(coalesce({expr}, '')), stem))) > 0)"


def in_list(expr: str, values: list[str]) -> str:
    return f"coalesce({expr} IN ({', '.join(q(v) for v in values)}), false)"


def cosine(a: str, b: str) -> str:
    return f"list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


def distance(a: str, b: str) -> str:
    return f"greatest(0.0, least(2.0, 1.0 - coalesce({cosine(a, b)}, 0.0)))"


def entries_documents() -> str:
    return ("SELECT CAST(doc_id AS VARCHAR) AS id, source AS preferred_name, text AS definition, doc_id AS seq "
            "FROM documents")


def clean_entries() -> str:
    return (f"SELECT id, preferred_name, {strip('definition')} AS definition, seq FROM ({entries_documents()}) "
            f"WHERE {has_letter(strip('definition'))}")


def text_vectors() -> str:
    return ("SELECT d.text AS text, arg_min(e.embedding, d.doc_id) AS embedding, min(d.doc_id) AS vec_key "
            "FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id GROUP BY d.text")


def yes_no_answer(expr: str) -> str:
    up = f"upper({strip(expr)})"
    return f"(CASE WHEN starts_with({up}, 'YES') THEN true WHEN starts_with({up}, 'NO') THEN false END)"


def yes_no_justification(expr: str) -> str:
    lead = fv.JUSTIFICATION_LEAD_CHARS.replace("-", "") + "-"
    rest = strip(f"regexp_replace(substr({strip(expr)}, 4), '^[{lead}]+', '')")
    return f"(CASE WHEN {rest} = '' THEN {q(fv.NO_JUSTIFICATION)} ELSE {rest} END)"


def verdict(a: str, b: str, n: str, s: str) -> str:
    return (f"(CASE WHEN NOT {a} OR NOT {b} THEN {q(fv.MISALIGNMENT)} WHEN NOT {n} THEN {q(fv.TRUE_REDUNDANCY)} "
            f"WHEN coalesce({s}, false) THEN {q(fv.DEFINITION_INSUFFICIENT)} ELSE {q(fv.VALID_DISTINCTION)} END)")


def extract_verdict(expr: str) -> str:
    up = f"upper(coalesce({expr}, ''))"
    whens = " ".join(f"WHEN contains({up}, {q(v)}) THEN {q(v)}" for v in fv.VERDICT_SEARCH_ORDER)
    return f"(CASE {whens} ELSE {q(fv.UNKNOWN)} END)"


def fill(template: str, **slots: str) -> str:
    """P20 in SQL: the template cut at its ``{slot}``s, concatenated with the slot expressions."""
    import re

    parts, pos = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if m.start() > pos:
            parts.append(q(template[pos:m.start()]))
        parts.append(f"coalesce(CAST({slots[m.group(1)]} AS VARCHAR), 'None')")
        pos = m.end()
    if pos < len(template):
        parts.append(q(template[pos:]))
    return "(" + " || ".join(parts) + ")"


def prompt_hash(system: str, user: str, model: str = "''") -> str:
    return f"sha256(concat_ws(chr(31), coalesce({model}, ''), {system}, {user}))"


def recorded_answer(answer: str, requests: str, name: str, model: str = "model") -> str:
    """``requests`` with a column ``name``: the recorded turn that the hash of (model, system, "user") names, or
    null; ``answer`` is an expression of ``v.text``."""
    return (f"(SELECT r.*, {answer} AS {name} FROM (SELECT *, {prompt_hash('system', '"user"', model)} AS pk FROM {requests}) r "
            f"LEFT JOIN conversations v ON v.conv_id = ('0x' || substr(pk, 1, 6))::BIGINT % (SELECT max(conv_id) + 1 FROM conversations) "
            f"AND v.turn = ('0x' || substr(pk, 7, 1))::BIGINT % 4)")


def parse_error(response: str) -> str:
    return (f"(CASE WHEN {response} IS NULL THEN 'no recorded answer' WHEN {yes_no_answer(response)} IS NULL THEN "
            f"'Expected YES/NO response, got: ' || coalesce({strip(response)}, '') END)")


def strip_trailing_group_ctes(prefix: str, source: str, key: str, col: str) -> str:
    """P9 in SQL over ``source(key, col)``: the characters before the last ``)`` are exploded, a
    running bracket balance is taken from the right, and the matching ``(`` is the rightmost
    position where the balance reaches one. Defines ``{prefix}_out(key, s, clean)``."""
    return f"""{prefix}_a AS (SELECT {key} AS k, {col} AS s, strpos(reverse({col}), ')') AS rp FROM {source}),
{prefix}_b AS (SELECT k, s, length(s) - rp + 1 AS lc FROM {prefix}_a WHERE rp > 0),
{prefix}_c AS (SELECT k, unnest(string_split(substr(s, 1, lc - 1), '')) AS ch,
                      unnest(generate_series(1, lc - 1)) AS pos FROM {prefix}_b WHERE lc > 1),
{prefix}_d AS (SELECT k, pos, sum(CASE ch WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END)
                      OVER (PARTITION BY k ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bal
               FROM {prefix}_c),
{prefix}_e AS (SELECT k, max(pos) AS open_pos FROM {prefix}_d WHERE bal = 1 GROUP BY k),
{prefix}_out AS (SELECT a.k, a.s, CASE WHEN e.open_pos IS NOT NULL THEN {strip('substr(a.s, 1, e.open_pos - 1)')}
                                   ELSE {strip('a.s')} END AS clean
                 FROM {prefix}_a a LEFT JOIN {prefix}_e e ON e.k = a.k)"""
