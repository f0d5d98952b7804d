"""Registered audit queries: candidate filters, prompt rendering, the two-round audit on recorded
answers, remediation, run counters, the model ablation, and answer parsing on ``conversations``.

The answers are turns of ``conversations`` (see ``ConversationAnswers``), so every audit query here has an
SQL mirror that looks the same answers up.
"""

from __future__ import annotations

import copy

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import text as T
from ..operators import audit as A
from ..operators import radius_tree as RT
from ..operators.util import attach_row
from ..session import materialize
from ..sources import tables as S
from . import sqlfrag as Q
from .registry import register
from .vector_queries import RADIUS, candidate_pairs_sql, matched_entries, named_pairs

LIMIT_N = 5                      # the audit's --limit: first N surviving pairs
TEST_SET_MAX_DISTANCE = 0.55     # fixture: closer pairs form the "similar" test set


def _r6(c):
    return F.round(F.col(c), 6)


# A YES/NO-style prefix chosen by the md5 of the text is put in front of each recorded text: almost no
# text of the table begins so by itself.
_PREFIXES = ["YES — ", "YES — ", "YES — ", "YES — ", "YES — ", "YES — ", "NO: ", "NO: ",
             "NO: ", "NO: ", "no", "Nothing ", "  yes-", "", "maybe ", "NO-"]


def _answer_expr() -> "F.Column":
    c = F.conv(F.substring(F.md5(F.col("text")), 1, 1), 16, 10).cast("int")
    pre = F.element_at(F.array(*[F.lit(p) for p in _PREFIXES]), c + 1)
    return F.concat(pre, F.col("text"))


def _answer_sql(text: str = "text") -> str:
    cases = " ".join(f"WHEN '{h}' THEN {Q.q(p)}" for h, p in zip("0123456789abcdef", _PREFIXES))
    return f"(CASE substr(md5({text}), 1, 1) {cases} END || {text})"


def _recorded_sql(requests: str, name: str) -> str:
    return Q.recorded_answer(_answer_sql("v.text"), requests, name)


class ConversationAnswers:
    """Recorded answers (L1): a prompt's hash names a conversation and one of its first four turns; the
    turn's text behind its prefix is the answer, and a prompt whose turn does not exist has none."""

    expression_based = True
    by_key = True

    def __init__(self, spark: SparkSession, sf_dir: str):
        turns = S.table(spark, sf_dir, "conversations")
        self.turns = turns.select("conv_id", "turn", _answer_expr().alias("response"))
        self.size = turns.agg((F.max("conv_id") + 1).alias("size"))

    def _named(self, requests: DataFrame) -> DataFrame:
        digits = lambda start, n: F.conv(F.substring("pkey", start, n), 16, 10).cast("long")
        return attach_row(requests, self.size).withColumn("conv_id", digits(1, 6) % F.col("size")).withColumn("turn", digits(7, 1) % 4).drop("size")

    def complete(self, requests: DataFrame) -> DataFrame:
        return A.TableBackend(self._named(requests.select("pkey")).join(self.turns, ["conv_id", "turn"])).complete(requests)

    def attach(self, requests: DataFrame) -> DataFrame:
        """The requests (pkey, …) with their answers, in one join."""
        return A.unanswered(self._named(requests).join(self.turns, ["conv_id", "turn"], "left").drop("conv_id", "turn"))

    def brief(self) -> "ConversationAnswers":
        """The same answers cut to what the YES/NO rules read in them, before they meet any request."""
        short = copy.copy(self)
        short.turns = self.turns.withColumn("response", A.brief_answer("response"))
        return short


def _kept_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries that kept pairs are made of, written once: (row, seq, ref, name, definition, embedding)."""
    kept = matched_entries(spark, sf_dir, prepare=A.prepare_entries)
    return materialize(kept.withColumn("row", F.monotonically_increasing_id()), "audit-entries")


def _near(entries: DataFrame) -> DataFrame:
    return RT.radius_tree_join(entries, RADIUS, id_col="seq")


def _kept_pairs(entries: DataFrame, pairs: DataFrame) -> DataFrame:
    """The kept pairs with their names, texts and ids; read once by the caller, so not written."""
    k = named_pairs(pairs, entries.select("seq", "ref", "definition", "name"))
    return k.select("distance", "preferred_names_a", "text_a", "preferred_names_b", "text_b", A.pair_id_expr().alias("pair_id"),
                    F.col("name_a").alias("name_1"), F.col("text_a").alias("def_1"), F.col("name_b").alias("name_2"), F.col("text_b").alias("def_2"))


def _audit_sides(entries: DataFrame) -> DataFrame:
    return entries.select("row", F.col("seq").alias("id"), "ref", "name", F.col("definition").alias("text"))


def _audit(entries: DataFrame, pairs: DataFrame, answers) -> DataFrame:
    return A.audit_entry_pairs(_audit_sides(entries), pairs, answers)


# ------------------------------------------------------------------------------------------------
# SQL mirror of the audit pipeline
# ------------------------------------------------------------------------------------------------


def _kept_sql() -> str:
    return candidate_pairs_sql(RADIUS) + f""",
kept AS (SELECT * FROM cand WHERE NOT ({Q.is_chemical('text_a')} OR {Q.is_chemical('text_b')})
                             AND NOT ({Q.in_list('text_a', fv.STRUCTURAL_DEFINITIONS)} OR {Q.in_list('text_b', fv.STRUCTURAL_DEFINITIONS)})),
nm AS (SELECT DISTINCT s FROM (SELECT preferred_names_a AS s FROM kept UNION ALL SELECT preferred_names_b FROM kept)),
{Q.strip_trailing_group_ctes('nmc', 'nm', 's', 's')},
pairs AS (SELECT k.*, md5(concat_ws(chr(31), coalesce(preferred_names_a, ''), text_a, coalesce(preferred_names_b, ''), text_b)) AS pair_id,
                 na.clean AS name_1, text_a AS def_1, nb.clean AS name_2, text_b AS def_2
          FROM kept k JOIN nmc_out na ON na.k = k.preferred_names_a JOIN nmc_out nb ON nb.k = k.preferred_names_b)"""


def _signals_sql(models: str) -> str:
    """CTEs ``mp`` (pairs × models), ``sig`` (signals, status, verdict) over ``pairs``."""
    r1 = " UNION ALL ".join([
        f"SELECT model, pair_id, 'alignment_a' AS role, {Q.q(fv.ALIGNMENT_SYSTEM_PROMPT)} AS system, "
        f"{Q.fill(fv.ALIGNMENT_USER_PROMPT, name='name_1', definition='def_1')} AS \"user\" FROM mp",
        f"SELECT model, pair_id, 'alignment_b', {Q.q(fv.ALIGNMENT_SYSTEM_PROMPT)}, "
        f"{Q.fill(fv.ALIGNMENT_USER_PROMPT, name='name_2', definition='def_2')} FROM mp",
        f"SELECT model, pair_id, 'names_distinct', {Q.q(fv.NAMES_DISTINCT_SYSTEM_PROMPT)}, "
        f"{Q.fill(fv.NAMES_DISTINCT_USER_PROMPT, name_1='name_1', name_2='name_2')} FROM mp"])
    parse = (f"SELECT model, pair_id, role, {Q.yes_no_answer('response')} AS answer, "
             f"CASE WHEN {Q.yes_no_answer('response')} IS NOT NULL THEN {Q.yes_no_justification('response')} END AS justification, "
             f"{Q.parse_error('response')} AS parse_error")
    piv = ", ".join(
        f"bool_or(answer) FILTER (WHERE role = '{r}') AS {r}, "
        f"max(justification) FILTER (WHERE role = '{r}') AS {r}_justification, "
        f"max(coalesce(parse_error, '')) FILTER (WHERE role = '{r}') AS {r}_error" for r in A.ROLES)

    def err(r):
        return f"(CASE WHEN {r}_error IS NULL THEN 'missing answer: {r}' WHEN {r}_error <> '' THEN {r}_error END)"

    error = (f"coalesce({err('alignment_a')}, {err('alignment_b')}, {err('names_distinct')}, "
             f"CASE WHEN names_distinct THEN {err('defs_too_similar')} END)")
    sim = "CASE WHEN names_distinct THEN defs_too_similar END"
    return f""",
mp AS (SELECT m.model, p.* FROM pairs p, ({models}) m),
r1 AS ({r1}),
p1 AS ({parse} FROM {_recorded_sql('r1', 'response')}),
need2 AS (SELECT model, pair_id FROM p1 GROUP BY model, pair_id
          HAVING count(*) FILTER (WHERE parse_error IS NULL) = 3 AND bool_or(answer) FILTER (WHERE role = 'names_distinct')),
r2 AS (SELECT mp.model, mp.pair_id, 'defs_too_similar' AS role, {Q.q(fv.DEFS_TOO_SIMILAR_SYSTEM_PROMPT)} AS system,
              {Q.fill(fv.DEFS_TOO_SIMILAR_USER_PROMPT, name_1='name_1', def_1='def_1', name_2='name_2', def_2='def_2')} AS "user"
       FROM mp JOIN need2 USING (model, pair_id)),
p2 AS ({parse} FROM {_recorded_sql('r2', 'response')}),
piv AS (SELECT model, pair_id, {piv} FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2) GROUP BY model, pair_id),
sig AS (SELECT model, pair_id,
               CASE WHEN {error} IS NULL THEN 'success' ELSE 'error' END AS status, {error} AS error,
               CASE WHEN {error} IS NULL THEN {Q.verdict('alignment_a', 'alignment_b', 'names_distinct', sim)} END AS verdict,
               CASE WHEN {error} IS NULL THEN alignment_a END AS alignment_a,
               CASE WHEN {error} IS NULL THEN alignment_a_justification END AS alignment_a_justification,
               CASE WHEN {error} IS NULL THEN alignment_b END AS alignment_b,
               CASE WHEN {error} IS NULL THEN alignment_b_justification END AS alignment_b_justification,
               CASE WHEN {error} IS NULL THEN names_distinct END AS names_distinct,
               CASE WHEN {error} IS NULL THEN names_distinct_justification END AS names_distinct_justification,
               CASE WHEN {error} IS NULL THEN {sim} END AS defs_too_similar,
               CASE WHEN {error} IS NULL THEN CASE WHEN names_distinct THEN defs_too_similar_justification END END
                    AS defs_too_similar_justification
        FROM piv)"""


_ONE_MODEL = "SELECT '' AS model"


def _fixes_sql() -> str:
    terms = f"""
terms AS (SELECT model, pair_id, 'A' AS term FROM sig WHERE status = 'success' AND (
              (verdict = {Q.q(fv.MISALIGNMENT)} AND NOT alignment_a) OR verdict = {Q.q(fv.DEFINITION_INSUFFICIENT)})
          UNION ALL
          SELECT model, pair_id, 'B' FROM sig WHERE status = 'success' AND (
              (verdict = {Q.q(fv.MISALIGNMENT)} AND NOT alignment_b) OR verdict = {Q.q(fv.DEFINITION_INSUFFICIENT)})),
treq AS (SELECT t.model, t.pair_id, t.term, {Q.q(fv.ISO_SYSTEM_PROMPT)} AS system,
                {Q.fill(fv.ISO_USER_PROMPT, term_name="CASE WHEN t.term = 'A' THEN p.name_1 ELSE p.name_2 END")} AS "user"
         FROM terms t JOIN pairs p USING (pair_id)),
fixes AS (SELECT model, pair_id, term, {Q.strip('answer')} AS definition
          FROM {_recorded_sql('treq', 'answer')} WHERE answer IS NOT NULL)"""
    return "," + terms


def _audit_sql() -> str:
    return _kept_sql() + _signals_sql(_ONE_MODEL) + _fixes_sql() + f""",
audit AS (SELECT p.distance, p.preferred_names_a, p.text_a, p.preferred_names_b, p.text_b,
                 {Q.extract_verdict('s.verdict')} AS verdict,
                 coalesce((SELECT max(definition) FROM fixes f WHERE f.pair_id = p.pair_id AND f.term = 'A'), '') AS llm_definition_a,
                 coalesce((SELECT max(definition) FROM fixes f WHERE f.pair_id = p.pair_id AND f.term = 'B'), '') AS llm_definition_b,
                 s.status
          FROM pairs p JOIN sig s USING (pair_id))"""


# ------------------------------------------------------------------------------------------------
# Queries
# ------------------------------------------------------------------------------------------------


@register("bracket_strip", "P9", f"""
WITH {Q.strip_trailing_group_ctes('bs', 'documents', 'doc_id', 'text')}
SELECT k AS doc_id, clean AS stripped FROM bs_out
""")
def bracket_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "documents").select("doc_id", T.strip_trailing_group("text").alias("stripped"))


@register("audit_skips", "P10 P11 J10", candidate_pairs_sql(RADIUS) + f"""
SELECT count(*) AS n_candidates,
       count(*) FILTER (WHERE {Q.is_chemical('text_a')} OR {Q.is_chemical('text_b')}) AS n_chemical,
       count(*) FILTER (WHERE NOT ({Q.is_chemical('text_a')} OR {Q.is_chemical('text_b')})
                        AND ({Q.in_list('text_a', fv.STRUCTURAL_DEFINITIONS)} OR {Q.in_list('text_b', fv.STRUCTURAL_DEFINITIONS)})) AS n_structural
FROM cand
""")
def audit_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = {"chem": T.is_chemical("definition"), "struct": T.is_structural("definition")}
    c = _flagged_pairs(matched_entries(spark, sf_dir, prepare=lambda d: d.withColumns(flags), texts=False).drop("ref"))
    chem, struct = F.col("chem_a") | F.col("chem_b"), F.col("struct_a") | F.col("struct_b")
    return c.agg(F.count(F.lit(1)).alias("n_candidates"), F.count_if(chem).alias("n_chemical"),
                 F.count_if(~chem & struct).alias("n_structural"))


def _flagged_pairs(entries: DataFrame) -> DataFrame:
    """The candidate pairs of entries (seq, embedding, flags …), with the flags of both sides: a text is looked at once, not
    in every pair."""
    entries = materialize(entries, "audit-flags")
    own = [c for c in entries.columns if c not in ("seq", "embedding")]
    side = lambda s: entries.select(F.col("seq").alias(f"id_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in own])
    return _near(entries).join(side("a"), "id_a").join(side("b"), "id_b")


@register("limit_after_filter", "P10 P11 T5", _kept_sql() + f"""
SELECT round(distance, 6) AS distance, preferred_names_a, text_a, preferred_names_b, text_b
FROM pairs ORDER BY distance, text_a, text_b LIMIT {LIMIT_N}
""")
def limit_after_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _kept_entries(spark, sf_dir)
    pairs = materialize(_near(entries), "audit-near")
    # the first N pairs are not farther than the N-th distance; texts order pairs of one distance only
    last = pairs.select("distance").orderBy("distance").limit(LIMIT_N).agg(F.max("distance").alias("last"))
    pairs = materialize(attach_row(pairs, last).where("distance <= last").drop("last"), "audit-first")
    ends = pairs.select(F.col("id_a").alias("seq")).union(pairs.select("id_b")).distinct()
    k = _kept_pairs(entries.join(ends, "seq", "left_semi"), pairs).orderBy("distance", "text_a", "text_b").limit(LIMIT_N)
    return k.select(_r6("distance").alias("distance"), "preferred_names_a", "text_a", "preferred_names_b", "text_b")


@register("render_prompts", "P9 P20", _kept_sql() + f"""
SELECT pair_id, 'alignment_a' AS role, {Q.fill(fv.ALIGNMENT_USER_PROMPT, name='name_1', definition='def_1')} AS prompt FROM pairs
UNION ALL SELECT pair_id, 'alignment_b', {Q.fill(fv.ALIGNMENT_USER_PROMPT, name='name_2', definition='def_2')} FROM pairs
UNION ALL SELECT pair_id, 'names_distinct', {Q.fill(fv.NAMES_DISTINCT_USER_PROMPT, name_1='name_1', name_2='name_2')} FROM pairs
UNION ALL SELECT pair_id, 'defs_too_similar', {Q.fill(fv.DEFS_TOO_SIMILAR_USER_PROMPT, name_1='name_1', def_1='def_1', name_2='name_2', def_2='def_2')} FROM pairs
UNION ALL SELECT pair_id, 'iso_a', {Q.fill(fv.ISO_USER_PROMPT, term_name='name_1')} FROM pairs
UNION ALL SELECT pair_id, 'iso_b', {Q.fill(fv.ISO_USER_PROMPT, term_name='name_2')} FROM pairs
""")
def render_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _kept_entries(spark, sf_dir)
    k = _kept_pairs(entries, _near(entries))
    prompts = F.array(
        F.struct(F.lit("alignment_a").alias("role"),
                 T.fill_template(fv.ALIGNMENT_USER_PROMPT, name=F.col("name_1"), definition=F.col("def_1")).alias("prompt")),
        F.struct(F.lit("alignment_b").alias("role"),
                 T.fill_template(fv.ALIGNMENT_USER_PROMPT, name=F.col("name_2"), definition=F.col("def_2")).alias("prompt")),
        F.struct(F.lit("names_distinct").alias("role"),
                 T.fill_template(fv.NAMES_DISTINCT_USER_PROMPT, name_1=F.col("name_1"), name_2=F.col("name_2")).alias("prompt")),
        F.struct(F.lit("defs_too_similar").alias("role"),
                 T.fill_template(fv.DEFS_TOO_SIMILAR_USER_PROMPT, name_1=F.col("name_1"), def_1=F.col("def_1"),
                                 name_2=F.col("name_2"), def_2=F.col("def_2")).alias("prompt")),
        F.struct(F.lit("iso_a").alias("role"), T.fill_template(fv.ISO_USER_PROMPT, term_name=F.col("name_1")).alias("prompt")),
        F.struct(F.lit("iso_b").alias("role"), T.fill_template(fv.ISO_USER_PROMPT, term_name=F.col("name_2")).alias("prompt")))
    return k.select("pair_id", F.explode(prompts).alias("p")).select("pair_id", "p.role", "p.prompt")


@register("audit_pairs", "L1 L2 L3 L4 L5 P16 P17 P18 P19 J12 S9", _audit_sql() + """
SELECT round(distance, 6) AS distance, preferred_names_a, text_a, preferred_names_b, text_b, verdict,
       llm_definition_a, llm_definition_b, status FROM audit
""")
def audit_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _kept_entries(spark, sf_dir)
    out = _audit(entries, _near(entries), ConversationAnswers(spark, sf_dir))
    pairs = out.select(F.col("row_a").alias("id_a"), F.col("row_b").alias("id_b"), _r6("distance").alias("distance"), "verdict",
                       "llm_definition_a", "llm_definition_b", "status")
    named = named_pairs(pairs, entries.select(F.col("row").alias("seq"), "ref", "definition"))
    return named.select("distance", "preferred_names_a", "text_a", "preferred_names_b", "text_b", "verdict", "llm_definition_a", "llm_definition_b", "status")


@register("remediation", "L3 P18", _kept_sql() + _signals_sql(_ONE_MODEL) + _fixes_sql() + """
SELECT pair_id, term, definition FROM fixes
""")
def remediation(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, answers = _kept_entries(spark, sf_dir), ConversationAnswers(spark, sf_dir)
    sig = A.audit_entries(_audit_sides(entries), _near(entries), answers, [""], detail=False)
    # a pair that occurs several times is mended once
    return A.remediation_rows(sig.dropDuplicates(["model", "pair_id"]), answers).select("pair_id", "term", "definition")


@register("verdict_counts", "A17", _audit_sql() + """
SELECT verdict, count(*) AS count FROM audit WHERE status = 'success' GROUP BY verdict
""")
def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _kept_entries(spark, sf_dir)
    return A.verdict_counts(_audit(entries, _near(entries), ConversationAnswers(spark, sf_dir)))


@register("run_counters", "A19", _audit_sql() + """
SELECT count(*) AS processed, count(*) FILTER (WHERE status = 'success') AS success,
       count(*) FILTER (WHERE status = 'error') AS error,
       count(*) FILTER (WHERE status = 'success' AND (llm_definition_a <> '' OR llm_definition_b <> '')) AS with_remediation
FROM audit
""")
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _kept_entries(spark, sf_dir)
    return A.run_counters(_audit(entries, _near(entries), ConversationAnswers(spark, sf_dir)))


# ------------------------------------------------------------------------------------------------
# Ablation: fixed models × test sets × tuples (J11, L6, A18, A20). Fixture test sets: pairs closer
# than TEST_SET_MAX_DISTANCE form "test"; the others are "unrelated", same domain when the two
# cleaned names agree, cross domain otherwise.
# ------------------------------------------------------------------------------------------------

_MODELS_SQL = " UNION ALL ".join(f"SELECT {Q.q(m)} AS model" for m in fv.ABLATION_MODELS)
_MODE_SQL = (f"CASE WHEN distance <= {TEST_SET_MAX_DISTANCE} THEN {Q.q(fv.TEST_SET_SIMILAR)} "
             f"WHEN name_1 = name_2 THEN {Q.q(fv.TEST_SET_SAME_DOMAIN)} ELSE {Q.q(fv.TEST_SET_CROSS_DOMAIN)} END")
_ABL_COLS = ("model, mode, tuple_id, name_1, name_2, verdict, status, alignment_a, alignment_a_justification, "
             "alignment_b, alignment_b_justification, names_distinct, names_distinct_justification, "
             "defs_too_similar, defs_too_similar_justification")


def _ablation_sql() -> str:
    return _kept_sql() + _signals_sql(_MODELS_SQL) + f""",
abl AS (SELECT s.model, {_MODE_SQL} AS mode, p.pair_id AS tuple_id, p.name_1, p.name_2, s.verdict, s.status,
               s.alignment_a, s.alignment_a_justification, s.alignment_b, s.alignment_b_justification,
               s.names_distinct, s.names_distinct_justification, s.defs_too_similar, s.defs_too_similar_justification
        FROM sig s JOIN pairs p USING (pair_id))"""


def ablation_df(spark: SparkSession, sf_dir: str, models: list[str] | None = None, detail: bool = True) -> DataFrame:
    """Every model (optionally a subset, J11) audits every tuple, without remediation; the justifications are
    null without ``detail``."""
    wanted = [m for m in fv.ABLATION_MODELS if models is None or m in models]
    entries = _kept_entries(spark, sf_dir)
    sig = A.audit_entries(_audit_sides(entries), _near(entries), ConversationAnswers(spark, sf_dir), wanted, detail=detail)
    mode = (F.when(F.col("distance") <= TEST_SET_MAX_DISTANCE, F.lit(fv.TEST_SET_SIMILAR))
            .when(F.col("name_1") == F.col("name_2"), F.lit(fv.TEST_SET_SAME_DOMAIN))
            .otherwise(F.lit(fv.TEST_SET_CROSS_DOMAIN)))
    return sig.select("model", mode.alias("mode"), F.col("pair_id").alias("tuple_id"), "name_1", "name_2", "verdict", "status",
                      "alignment_a", "alignment_a_justification", "alignment_b", "alignment_b_justification",
                      "names_distinct", "names_distinct_justification", "defs_too_similar",
                      "defs_too_similar_justification")


@register("ablation_results", "J11 L6 P21 S9", _ablation_sql() + f"""
SELECT {_ABL_COLS} FROM abl
""")
def ablation_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablation_df(spark, sf_dir)


@register("ablation_summary", "A18", _ablation_sql() + """
SELECT model, mode, verdict, count(*) AS count FROM abl WHERE status = 'success' GROUP BY model, mode, verdict
""")
def ablation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.verdict_counts(ablation_df(spark, sf_dir, detail=False), ("model", "mode"))


@register("expected_verdicts", "A20", _ablation_sql() + f"""
SELECT model, mode, count(*) AS n_success,
       count(*) FILTER (WHERE verdict = {Q.q(fv.EXPECTED_UNRELATED_VERDICT)}) AS n_expected,
       count(*) FILTER (WHERE verdict <> {Q.q(fv.EXPECTED_UNRELATED_VERDICT)}) AS n_violations,
       count(*) FILTER (WHERE verdict = {Q.q(fv.EXPECTED_UNRELATED_VERDICT)}) / count(*) AS pass_rate
FROM abl WHERE status = 'success' AND mode IN ({', '.join(Q.q(m) for m in fv.UNRELATED_TEST_SETS)})
GROUP BY model, mode
""")
def expected_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.expected_verdicts(ablation_df(spark, sf_dir, detail=False))


@register("audit_counters", "A19 P10 P11 L5", _audit_sql() + f""",
sk AS (SELECT count(*) AS skipped FROM cand WHERE {Q.is_chemical('text_a')} OR {Q.is_chemical('text_b')}
       OR {Q.in_list('text_a', fv.STRUCTURAL_DEFINITIONS)} OR {Q.in_list('text_b', fv.STRUCTURAL_DEFINITIONS)})
SELECT count(*) AS processed, count(*) FILTER (WHERE status = 'success') AS success,
       count(*) FILTER (WHERE status = 'error') AS error,
       count(*) FILTER (WHERE status = 'success' AND (llm_definition_a <> '' OR llm_definition_b <> '')) AS with_remediation, any_value(skipped) AS skipped
FROM audit, sk
""")
def audit_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    skip = T.is_chemical("definition") | T.is_structural("definition")
    flagged = matched_entries(spark, sf_dir, prepare=lambda d: d.withColumn("skip", skip), texts=False).drop("ref")
    candidates = materialize(_flagged_pairs(flagged).select("id_a", "id_b", "distance", (F.col("skip_a") | F.col("skip_b")).alias("skip")), "audit-candidates")
    kept = _kept_entries(spark, sf_dir)
    counted = A.run_counters(_audit(kept, candidates.where("not skip").drop("skip"), ConversationAnswers(spark, sf_dir)))
    return attach_row(counted, candidates.agg(F.count_if("skip").alias("skipped")))


@register("unexpected_verdicts", "A20 L6", _ablation_sql() + f"""
SELECT model, mode, tuple_id, name_1, name_2, verdict FROM abl
WHERE status = 'success' AND verdict <> {Q.q(fv.EXPECTED_UNRELATED_VERDICT)} AND mode IN ({', '.join(Q.q(m) for m in fv.UNRELATED_TEST_SETS)})
""")
def unexpected_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.unexpected_verdicts(ablation_df(spark, sf_dir, detail=False))


def _single_prompts_sql() -> str:
    audit = Q.fill(fv.SINGLE_AUDIT_USER_PROMPT, name_1='name_1', def_1='def_1', name_2='name_2', def_2='def_2')
    parts = [f"SELECT pair_id, {v} AS version, 'audit' AS role, {audit} AS prompt FROM pairs" for v in (1, 2, 3)]
    for role, own, other in (("definition_a", "name_1", "name_2"), ("definition_b", "name_2", "name_1")):
        parts.append(f"SELECT pair_id, 2, '{role}', {Q.fill(fv.ANTAGONIST_USER_PROMPT, term=own, antagonist=other)} FROM pairs")
        parts.append(f"SELECT pair_id, 3, '{role}', {Q.fill(fv.ISO_USER_PROMPT, term_name=own)} FROM pairs")
    return " UNION ALL ".join(parts)


@register("render_single_prompts", "P20", _kept_sql() + _single_prompts_sql())
def render_single_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompts of the sets 1 to 3 for every kept pair."""
    entries = _kept_entries(spark, sf_dir)
    r = A.single_prompt_requests(_kept_pairs(entries, _near(entries)), [1, 2, 3])
    return r.select("pair_id", "version", "role", F.col("user").alias("prompt"))


_FREE = ("'### Analysis\n- Alignment: Pass\n' || text || '\n### Diagnosis\n- Category: ' || "
         f"list_extract([{', '.join(Q.q(v.title()) for v in fv.VERDICT_SEARCH_ORDER)}, 'none of these'], 1 + ('0x' || substr(md5(text), 1, 2))::INT % 5)")


@register("free_answers", "P19", f"""
SELECT conv_id, turn, {Q.extract_verdict('a')} AS verdict FROM (SELECT conv_id, turn, {_FREE} AS a FROM conversations)
""")
def free_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of free answers, as the sets 1 to 3 ask for them: analysis, text and a ``Category:`` line."""
    names = F.array(*[F.lit(v.title()) for v in fv.VERDICT_SEARCH_ORDER], F.lit("none of these"))
    pick = F.conv(F.substring(F.md5("text"), 1, 2), 16, 10).cast("int") % 5 + 1
    answer = F.concat(F.lit("### Analysis\n- Alignment: Pass\n"), "text", F.lit("\n### Diagnosis\n- Category: "), F.element_at(names, pick))
    return S.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.extract_verdict(answer).alias("verdict"))


# ------------------------------------------------------------------------------------------------
# Answer parsing on conversations: a YES/NO-style prefix chosen by the md5 of the text is put in
# front of each text; turns 0–3 of a conversation play alignment A, alignment B, names distinct
# and definitions too similar.
# ------------------------------------------------------------------------------------------------


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "conversations").select("conv_id", "turn", _answer_expr().alias("response"))


@register("yes_no_parse", "P16", f"""
SELECT conv_id, turn, {Q.yes_no_answer('r')} AS answer,
       CASE WHEN {Q.yes_no_answer('r')} IS NOT NULL THEN {Q.yes_no_justification('r')} END AS justification,
       CASE WHEN {Q.yes_no_answer('r')} IS NOT NULL THEN 'success' ELSE 'error' END AS status
FROM (SELECT conv_id, turn, {_answer_sql()} AS r FROM conversations)
""")
def yes_no_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _answers(spark, sf_dir)
    ans = T.yes_no_answer("response")
    return a.select("conv_id", "turn", ans.alias("answer"),
                    F.when(ans.isNotNull(), T.yes_no_justification("response")).alias("justification"),
                    F.when(ans.isNotNull(), F.lit("success")).otherwise(F.lit("error")).alias("status"))


def _conv_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = F.array(*[F.lit(r) for r in A.ROLES])
    a = (_answers(spark, sf_dir)
         .withColumn("turn_group", F.floor(F.col("turn") / len(A.ROLES)).cast("long"))
         .withColumn("role", F.element_at(roles, (F.col("turn") % len(A.ROLES) + 1).cast("int")))
         .withColumn("error", F.lit(None).cast("string")))
    return A.signals_from_answers(A.parse_answers(a), ["conv_id", "turn_group"])


def _conv_signals_sql() -> str:
    roles = " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(A.ROLES))
    parse = (f"SELECT conv_id, turn_group, role, {Q.yes_no_answer('response')} AS answer, "
             f"CASE WHEN {Q.yes_no_answer('response')} IS NOT NULL THEN {Q.yes_no_justification('response')} END AS justification, "
             f"{Q.parse_error('response')} AS parse_error")
    piv = ", ".join(
        f"bool_or(answer) FILTER (WHERE role = '{r}') AS {r}, "
        f"max(justification) FILTER (WHERE role = '{r}') AS {r}_justification, "
        f"max(coalesce(parse_error, '')) FILTER (WHERE role = '{r}') AS {r}_error" for r in A.ROLES)

    def err(r):
        return f"(CASE WHEN {r}_error IS NULL THEN 'missing answer: {r}' WHEN {r}_error <> '' THEN {r}_error END)"

    error = (f"coalesce({err('alignment_a')}, {err('alignment_b')}, {err('names_distinct')}, "
             f"CASE WHEN names_distinct THEN {err('defs_too_similar')} END)")
    sim = "CASE WHEN names_distinct THEN defs_too_similar END"
    return f"""WITH a AS (SELECT conv_id, CAST(turn // {len(A.ROLES)} AS BIGINT) AS turn_group, CASE turn % {len(A.ROLES)} {roles} END AS role, {_answer_sql()} AS response
           FROM conversations),
p AS ({parse} FROM a),
piv AS (SELECT conv_id, turn_group, {piv} FROM p GROUP BY conv_id, turn_group),
sig AS (SELECT conv_id, turn_group, CASE WHEN {error} IS NULL THEN 'success' ELSE 'error' END AS status, {error} AS error,
               CASE WHEN {error} IS NULL THEN {Q.verdict('alignment_a', 'alignment_b', 'names_distinct', sim)} END AS verdict,
               CASE WHEN {error} IS NULL THEN alignment_a END AS alignment_a,
               CASE WHEN {error} IS NULL THEN alignment_b END AS alignment_b,
               CASE WHEN {error} IS NULL THEN names_distinct END AS names_distinct,
               CASE WHEN {error} IS NULL THEN {sim} END AS defs_too_similar
        FROM piv)"""


@register("verdicts", "P16 P17 L2", _conv_signals_sql() + """
SELECT conv_id, turn_group, status, error, verdict, alignment_a, alignment_b, names_distinct, defs_too_similar FROM sig
""")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conv_signals(spark, sf_dir).select("conv_id", "turn_group", "status", "error", "verdict", "alignment_a", "alignment_b",
                                              "names_distinct", "defs_too_similar")


@register("terms_to_fix", "P18", _conv_signals_sql() + f"""
SELECT conv_id, turn_group, 'A' AS term FROM sig WHERE status = 'success' AND ((verdict = {Q.q(fv.MISALIGNMENT)} AND NOT alignment_a)
                                                           OR verdict = {Q.q(fv.DEFINITION_INSUFFICIENT)})
UNION ALL
SELECT conv_id, turn_group, 'B' FROM sig WHERE status = 'success' AND ((verdict = {Q.q(fv.MISALIGNMENT)} AND NOT alignment_b)
                                                        OR verdict = {Q.q(fv.DEFINITION_INSUFFICIENT)})
""")
def terms_to_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _conv_signals(spark, sf_dir).filter(F.col("status") == "success")
    terms = T.terms_to_fix_expr("alignment_a", "alignment_b", "names_distinct", "defs_too_similar")
    return s.select("conv_id", "turn_group", F.explode(terms).alias("term"))


@register("verdict_extract", "P19", _conv_signals_sql() + f"""
SELECT conv_id, turn_group, {Q.extract_verdict('verdict')} AS verdict FROM sig
""")
def verdict_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conv_signals(spark, sf_dir).select("conv_id", "turn_group", T.extract_verdict("verdict").alias("verdict"))
