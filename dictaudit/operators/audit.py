"""LLM audit of candidate pairs.

Requests and answers are tables. A pair needs three prompts in round 1 (alignment of A, alignment of
B, names distinct) and one more in round 2 (definitions too similar) only when its names are
distinct; remediation asks one definition per failing term, from the name only. Every round:

1. builds request rows ``(pkey, system, user)`` with ``pkey = sha2(model, system, user)``;
2. asks each *distinct* prompt once (the same entry's alignment prompt recurs in many pairs);
3. joins the answers back by ``pkey`` and parses them with column expressions.

Backends (L1):

* ``MockBackend`` — a deterministic answer computed by a Spark expression from the prompt hash
  (no Python, SQL-checkable); used by the registered queries and tests.
* ``TableBackend`` — recorded answers, looked up by an equi-join on ``pkey``.
* ``CallableBackend`` — any ``fn(system, user, model) -> str`` (a client for a model server),
  run by ``mapInPandas`` with one client per partition, ``n_clients`` partitions bounding the
  concurrency, retries, and failures captured as ``error`` (never raised). Its answers are written
  to a table in the shared checkpoint folder before use, so a recomputed lineage never asks the
  model again. ``answer_store.StoredBackend`` keeps answers over runs.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import text as T
from ..session import materialize
from . import pair_entries as PE
from .util import attach_row

SEP = "\x1f"
ANSWER_SCHEMA = "pkey string, response string, error string"


def prompt_key(system: Column, user: Column, model: Column | None = None) -> Column:
    m = model if model is not None else F.lit("")
    return F.sha2(F.concat_ws(SEP, F.coalesce(m, F.lit("")), system, user), 256)


class MockBackend:
    """Deterministic answers from the md5 of ``model, system, user``.

    Yes/no prompts: first hex digit 0–b → ``YES — …``, c–d → ``NO — …``, e → ``Nothing …`` (parses
    as NO, the prefix rule), f → ``Unclear …`` (a parse error). Definition prompts (ISO system
    prompt) get ``Mock definition <hash>``.
    """

    expression_based = True

    @staticmethod
    def hash_expr(system: Column, user: Column, model: Column | None = None) -> Column:
        m = model if model is not None else F.lit("")
        return F.md5(F.concat_ws(SEP, F.coalesce(m, F.lit("")), system, user))

    @staticmethod
    def answer_from_hash(system: Column, h: Column) -> Column:
        c = F.substring(h, 1, 1)
        tail = F.substring(h, 2, 8)
        return (F.when(system == F.lit(fv.ISO_SYSTEM_PROMPT), F.concat(F.lit("Mock definition "), F.substring(h, 1, 12)))
                .when(c.isin(*"0123456789ab"), F.concat(F.lit("YES — mock "), tail))
                .when(c.isin("c", "d"), F.concat(F.lit("NO — mock "), tail))
                .when(c == "e", F.concat(F.lit("Nothing "), tail))
                .otherwise(F.concat(F.lit("Unclear "), tail)))

    def answer_expr(self, system: Column, user: Column, model: Column | None = None) -> Column:
        return self.answer_from_hash(system, self.hash_expr(system, user, model))

    def complete(self, requests: DataFrame) -> DataFrame:
        model = F.col("model") if "model" in requests.columns else None
        # the prompt hash is a column first, so the prompt text is hashed once per request
        hashed = requests.select("pkey", "system", self.hash_expr(F.col("system"), F.col("user"), model).alias("_h"))
        return hashed.select("pkey", self.answer_from_hash(F.col("system"), F.col("_h")).alias("response"),
                             F.lit(None).cast("string").alias("error"))


class TableBackend:
    """Recorded answers ``(pkey, response)``; a prompt without a record is an error row."""

    expression_based = True
    by_key = True  # answers from pkey alone: the prompt's text is not sent along

    def __init__(self, answers: DataFrame):
        self.answers = answers.select("pkey", "response")

    def complete(self, requests: DataFrame) -> DataFrame:
        j = requests.select("pkey").join(self.answers, "pkey", "left")
        return j.select("pkey", "response",
                        F.when(F.col("response").isNull(), F.lit("no recorded answer")).alias("error"))

    def attach(self, requests: DataFrame) -> DataFrame:
        """The requests (pkey, …) with their answers, as by :meth:`complete` and a join, in one join."""
        return unanswered(requests.join(self.answers, "pkey", "left"))

    def brief(self) -> "TableBackend":
        """The same answers cut to what the YES/NO rules read in them."""
        return TableBackend(self.answers.withColumn("response", brief_answer("response")))


def unanswered(answers: DataFrame) -> DataFrame:
    return answers.withColumn("error", F.when(F.col("response").isNull(), F.lit("no recorded answer")))


def brief_answer(response: str) -> Column:
    """``YES``, ``NO`` or an empty answer that parses as the response does; null stays null."""
    ans = T.yes_no_answer(T.ustrip(response))
    return F.when(F.col(response).isNotNull(), F.when(ans, F.lit("YES")).when(~ans, F.lit("NO")).otherwise(F.lit("")))


class CallableBackend:
    """Answers from ``fn(system, user, model) -> str`` inside ``mapInPandas``."""

    expression_based = False

    def __init__(self, fn: Callable[[str, str, str], str], n_clients: int = 4, retries: int = 2,
                 backoff_s: float = 0.5, model: str = ""):
        """``model`` (S11) is asked when a request names none; an endpoint or a context window is the client's."""
        self.fn, self.n_clients, self.retries, self.backoff_s, self.model = fn, n_clients, retries, backoff_s, model

    def plan(self, requests: DataFrame) -> DataFrame:
        """The plan that asks; run it once and keep what it gives."""
        fn, retries, backoff, default_model = self.fn, self.retries, self.backoff_s, self.model
        cols = ["pkey", "system", "user"] + (["model"] if "model" in requests.columns else [])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out_r, out_e = [], []
                for row in pdf.itertuples(index=False):
                    model = getattr(row, "model", None) or default_model
                    resp, err = None, None
                    if not (row.system or "").strip() or not (row.user or "").strip():
                        err = "blank prompt"
                    else:
                        for attempt in range(retries + 1):
                            try:
                                resp = fn(row.system, row.user, model)
                                if resp is None or not str(resp).strip():
                                    resp, err = None, "empty answer"
                                else:
                                    err = None
                                break
                            except Exception as exc:  # noqa: BLE001 - the failure becomes a column
                                err = f"{type(exc).__name__}: {exc}"
                                time.sleep(backoff * (attempt + 1))
                    out_r.append(resp)
                    out_e.append(err)
                yield pd.DataFrame({"pkey": pdf["pkey"], "response": out_r, "error": out_e})

        return requests.select(*cols).repartition(self.n_clients).mapInPandas(run, ANSWER_SCHEMA)

    def complete(self, requests: DataFrame) -> DataFrame:
        return materialize(self.plan(requests), "llm-answers")


def ask(requests: DataFrame, backend) -> DataFrame:
    """L1 + J12: answer every distinct prompt once and join the answers back to all requests."""
    if getattr(backend, "by_key", False):
        requests = requests.drop("system", "user")
        return requests.join(backend.complete(requests.select("pkey").distinct()), "pkey", "left")
    cols = ["pkey", "system", "user"] + (["model"] if "model" in requests.columns else [])
    distinct = requests.select(*cols).dropDuplicates(["pkey"])
    answers = backend.complete(distinct)
    return requests.join(answers, "pkey", "left")


def ask_recorded(requests: DataFrame, backend) -> DataFrame:
    """:func:`ask` for a backend that answers by key: nothing is asked twice by looking a record up again, so requests that
    are narrow rows are answered where they are."""
    return backend.attach(requests) if hasattr(backend, "attach") else ask(requests, backend)


def _parsed(df: DataFrame) -> DataFrame:
    # The stripped answer and the parsed value are columns, referenced by name below: repeating
    # the expressions would multiply the plan's expression trees (and the driver's analysis time).
    s = df.withColumn("_stripped", T.ustrip("response"))
    s = s.withColumn("answer", T.yes_no_answer("_stripped"))
    ans = F.col("answer")
    return (s.withColumn("justification", F.when(ans.isNotNull(), T.yes_no_justification("_stripped")))
            .withColumn("parse_error",
                        F.when(F.col("error").isNotNull(), F.col("error"))
                        .when(ans.isNull(), F.concat(F.lit("Expected YES/NO response, got: "),
                                                     F.coalesce(F.col("_stripped"), F.lit("")))))
            .drop("_stripped"))


def _with_model(df: DataFrame, model: str | None) -> DataFrame:
    if "model" in df.columns:
        return df
    # An empty string, not null, so the model takes part in equi-joins.
    return df.withColumn("model", F.lit(model if model is not None else "").cast("string"))


def round1_requests(pairs: DataFrame) -> DataFrame:
    """Three prompts per pair: alignment A, alignment B, names distinct."""
    reqs = F.array(
        F.struct(F.lit("alignment_a").alias("role"), F.lit(fv.ALIGNMENT_SYSTEM_PROMPT).alias("system"),
                 T.fill_template(fv.ALIGNMENT_USER_PROMPT, name=F.col("name_1"), definition=F.col("def_1")).alias("user")),
        F.struct(F.lit("alignment_b").alias("role"), F.lit(fv.ALIGNMENT_SYSTEM_PROMPT).alias("system"),
                 T.fill_template(fv.ALIGNMENT_USER_PROMPT, name=F.col("name_2"), definition=F.col("def_2")).alias("user")),
        F.struct(F.lit("names_distinct").alias("role"), F.lit(fv.NAMES_DISTINCT_SYSTEM_PROMPT).alias("system"),
                 T.fill_template(fv.NAMES_DISTINCT_USER_PROMPT, name_1=F.col("name_1"), name_2=F.col("name_2")).alias("user")),
    )
    r = pairs.select("pair_id", "model", F.explode(reqs).alias("r")).select("pair_id", "model", "r.*")
    return r.withColumn("pkey", prompt_key(F.col("system"), F.col("user"), F.col("model")))


def round2_requests(pairs: DataFrame) -> DataFrame:
    user = T.fill_template(fv.DEFS_TOO_SIMILAR_USER_PROMPT, name_1=F.col("name_1"), def_1=F.col("def_1"),
                           name_2=F.col("name_2"), def_2=F.col("def_2"))
    r = pairs.select("pair_id", "model", F.lit("defs_too_similar").alias("role"),
                     F.lit(fv.DEFS_TOO_SIMILAR_SYSTEM_PROMPT).alias("system"), user.alias("user"))
    return r.withColumn("pkey", prompt_key(F.col("system"), F.col("user"), F.col("model")))


ROLES = ["alignment_a", "alignment_b", "names_distinct", "defs_too_similar"]


def parse_answers(answers: DataFrame) -> DataFrame:
    """P16 on an answer table ``(…, role, response, error)``: adds ``answer``, ``justification``,
    ``parse_error``."""
    return _parsed(answers)


def signals_from_answers(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Pivot parsed answers (one row per key and role) into audit signals, status and verdict.

    Round-1 roles must all parse; the too-similar answer counts only when the names are distinct
    (otherwise it is null, as if skipped). The first failing prompt, in prompt order, gives the
    error; a missing answer is an error. Verdicts (P17) exist for successful rows only.
    """
    agg = []
    for role in ROLES:
        sel = F.col("role") == role
        agg += [F.max(F.when(sel, F.col("answer"))).alias(role),
                F.max(F.when(sel, F.col("justification"))).alias(f"{role}_justification"),
                F.max(F.when(sel, F.coalesce(F.col("parse_error"), F.lit("")))).alias(f"{role}_error")]
    return _decided(parsed.groupBy(*keys).agg(*agg), keys)


def _decided(sig: DataFrame, keys: list[str]) -> DataFrame:
    """Status, error, verdict and signals of rows that hold, for each role, its answer (``<role>``),
    ``<role>_justification`` and ``<role>_error`` ("" without one, null without an answer)."""

    def err(role: str) -> Column:
        e = F.col(f"{role}_error")
        return F.when(e.isNull(), F.lit(f"missing answer: {role}")).when(e != "", e)

    nd = F.col("names_distinct")
    # error, skipped-aware too-similar signal and verdict become columns once and are referenced
    # by name, instead of repeating their expressions in every output column
    sig = (sig.withColumn("_error", F.coalesce(err("alignment_a"), err("alignment_b"), err("names_distinct"),
                                               F.when(nd, err("defs_too_similar"))))
           .withColumn("_sim", F.when(nd, F.col("defs_too_similar")))
           .withColumn("_sim_j", F.when(nd, F.col("defs_too_similar_justification"))))
    sig = sig.withColumn("_verdict", T.verdict_expr("alignment_a", "alignment_b", "names_distinct", "_sim"))
    ok = F.col("_error").isNull()
    return sig.select(
        *keys,
        F.when(ok, F.lit("success")).otherwise(F.lit("error")).alias("status"),
        F.col("_error").alias("error"),
        F.when(ok, F.col("_verdict")).alias("verdict"),
        *[F.when(ok, F.col(c)).alias(c) for c in
          ("alignment_a", "alignment_a_justification", "alignment_b", "alignment_b_justification",
           "names_distinct", "names_distinct_justification")],
        F.when(ok, F.col("_sim")).alias("defs_too_similar"),
        F.when(ok, F.col("_sim_j")).alias("defs_too_similar_justification"))


def prompt_keys(pairs: DataFrame, models: list[str] | None = None) -> DataFrame:
    """The pairs with ``keys``: per model (the pair's own without a list) the keys of its four prompts, 32 bytes
    each, in the order of ``ROLES``. Each prompt is rendered once and its text stays in the row's task."""
    fill = {"alignment_a": (fv.ALIGNMENT_SYSTEM_PROMPT, T.fill_template(fv.ALIGNMENT_USER_PROMPT, name=F.col("name_1"), definition=F.col("def_1"))),
            "alignment_b": (fv.ALIGNMENT_SYSTEM_PROMPT, T.fill_template(fv.ALIGNMENT_USER_PROMPT, name=F.col("name_2"), definition=F.col("def_2"))),
            "names_distinct": (fv.NAMES_DISTINCT_SYSTEM_PROMPT, T.fill_template(fv.NAMES_DISTINCT_USER_PROMPT, name_1=F.col("name_1"), name_2=F.col("name_2"))),
            "defs_too_similar": (fv.DEFS_TOO_SIMILAR_SYSTEM_PROMPT, T.fill_template(
                fv.DEFS_TOO_SIMILAR_USER_PROMPT, name_1=F.col("name_1"), def_1=F.col("def_1"), name_2=F.col("name_2"), def_2=F.col("def_2")))}
    rendered = pairs.select("*", *[fill[r][1].alias(f"_user_{r}") for r in ROLES])
    named = [F.lit(m) for m in models] if models is not None else [F.col("model")]
    keys = F.array(*[F.struct(m.alias("model"), F.array(*[
        F.unhex(prompt_key(F.lit(fill[r][0]), F.col(f"_user_{r}"), m)) for r in ROLES]).alias("pkeys")) for m in named])
    return rendered.select(*pairs.columns, keys.alias("keys"))


def _keyed_requests(keyed: DataFrame, roles: list[str]) -> DataFrame:
    each = F.array(*[F.struct(F.lit(r).alias("role"), F.lower(F.hex(F.col("pkeys")[ROLES.index(r)])).alias("pkey")) for r in roles])
    return keyed.select("pair_id", "model", F.explode(each).alias("r")).select("pair_id", "model", "r.*")


def audit_signals(pairs: DataFrame, backend, model: str | None = None, detail: bool = True) -> DataFrame:
    """L2 + L4 without remediation: signals, status, error and verdict per ``(model, pair_id)``.

    ``pairs`` needs ``pair_id, name_1, def_1, name_2, def_2`` (and optionally ``model``), or ``pair_id`` and
    :func:`prompt_keys`' ``keys`` for a backend that answers by key; then no prompt text is shuffled or written.
    Round 2 asks the too-similar prompt only for pairs whose round 1 succeeded with distinct names. Without
    ``detail`` the justifications and errors are null: their texts are not carried through the rounds.
    """
    # a pair that occurs several times is asked once; callers join the signals back to all its rows
    if getattr(backend, "by_key", False):
        keyed = pairs if "keys" in pairs.columns else prompt_keys(_with_model(pairs, model))
        pairs = keyed.select("pair_id", F.explode("keys").alias("k")).select("k.model", "pair_id", "k.pkeys").dropDuplicates(["model", "pair_id"])
        first_requests, second_requests = (lambda p: _keyed_requests(p, ROLES[:3])), (lambda p: _keyed_requests(p, ROLES[3:]))
    else:
        pairs = _with_model(pairs, model).dropDuplicates(["model", "pair_id"])
        first_requests, second_requests = round1_requests, round2_requests

    def answered(requests: DataFrame) -> DataFrame:
        a = _parsed(ask(requests, backend)).select("model", "pair_id", "role", "answer", "justification", "parse_error")
        if detail:
            return a
        return a.withColumn("justification", F.lit(None).cast("string")).withColumn(
            "parse_error", F.when(F.col("parse_error").isNotNull(), F.lit("error")))

    # round 1 decides round 2 and is part of the result: written once
    r1 = materialize(answered(first_requests(pairs)), "audit-round1")
    first = r1.groupBy("model", "pair_id").agg(
        F.count_if(F.col("parse_error").isNull()).alias("_ok"),
        F.max(F.when(F.col("role") == "names_distinct", F.col("answer"))).alias("_nd"))
    need2 = first.filter((F.col("_ok") == 3) & F.col("_nd")).select("model", "pair_id")
    r2 = answered(second_requests(pairs.join(need2, ["model", "pair_id"])))
    sig = signals_from_answers(r1.unionByName(r2), ["model", "pair_id"])
    return sig if detail else sig.withColumn("error", F.lit(None).cast("string"))


def remediation(pairs: DataFrame, signals: DataFrame, backend) -> DataFrame:
    """L3: one ISO-definition request per failing term (from the name only), asked once per
    distinct name; a failed answer leaves the term out. Output: ``model, pair_id, term, definition``."""
    terms = T.terms_to_fix_expr("alignment_a", "alignment_b", "names_distinct", "defs_too_similar")
    names = pairs.select(*[c for c in ("model", "pair_id") if c in pairs.columns], "name_1", "name_2")
    names = names.dropDuplicates([c for c in ("model", "pair_id") if c in names.columns])
    todo = (signals.filter(F.col("status") == "success")
            .select("model", "pair_id", F.explode(terms).alias("term"))
            .join(names, [c for c in ("model", "pair_id") if c in names.columns])
            .select("model", "pair_id", "term",
                    F.when(F.col("term") == "A", F.col("name_1")).otherwise(F.col("name_2")).alias("term_name")))
    req = todo.select("model", "pair_id", "term", F.lit(fv.ISO_SYSTEM_PROMPT).alias("system"),
                      T.fill_template(fv.ISO_USER_PROMPT, term_name=F.col("term_name")).alias("user"))
    req = req.withColumn("pkey", prompt_key(F.col("system"), F.col("user"), F.col("model")))
    return _definitions(ask(req, backend), ["model", "pair_id", "term"])


def _definitions(answers: DataFrame, keys: list[str]) -> DataFrame:
    return (answers.filter(F.col("error").isNull() & F.col("response").isNotNull())
            .select(*keys, T.ustrip("response").alias("definition")))


def prepare_entries(entries: DataFrame) -> DataFrame:
    """L5 front for entries (definition, ref, …) whose pairs are not made yet: a pair is dropped where one of its two texts is
    chemical (P10) or structural (P11), so such entries form no kept pair; the bracket group goes from the names (P9)."""
    kept = entries.filter(~T.is_chemical("definition")).filter(~T.is_structural("definition"))
    return kept.withColumn("name", T.strip_trailing_group("ref"))


def _by_model(answers: DataFrame, keys: list[str], detail: bool) -> DataFrame:
    """(keys, answers): what a prompt got from each model, an array by model. Of repeated records counts and maxima, as in
    :func:`signals_from_answers`."""
    p = _parsed(answers)
    error = F.coalesce(F.col("parse_error") if detail else F.when(F.col("parse_error").isNotNull(), F.lit("error")), F.lit(""))
    why = F.max("justification") if detail else F.lit(None).cast("string")
    each = p.groupBy(*keys, "m").agg(F.count_if(F.col("parse_error").isNull()).alias("n_ok"), F.max("answer").alias("answer"),
                                     why.alias("justification"), F.max(error).alias("error"))
    return each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("m", "n_ok", "answer", "justification", "error"))).alias("answers"))


def _model_requests(rows: DataFrame, keys: list[str], system: str, models: list[str]) -> DataFrame:
    """(keys, m, pkey) of the prompt ``_user`` of each row, for every model."""
    each = F.array(*[F.struct(F.lit(m).alias("m"), prompt_key(F.lit(system), F.col("_user"), F.lit(name)).alias("pkey")) for m, name in enumerate(models)])
    return rows.select(*keys, F.explode(each).alias("r")).select(*keys, "r.m", "r.pkey")


def audit_entries(entries: DataFrame, pairs: DataFrame, backend, models: list[str], detail: bool = True) -> DataFrame:
    """L2 + L4 without remediation for pairs (id_a, id_b, distance) of ``entries`` (row, id, ref, name, text), for a backend that
    answers by key: the rows of :func:`audit_signals`, one for each pair and model, with ``pid`` (a number of the pair),
    ``row_a``, ``row_b``, ``distance``, ``name_1`` and ``name_2``.

    The alignment prompts belong to entries and are asked once for each, the prompts on names once for two names; only the
    too-similar prompt belongs to a pair. The pairs carry ids, hashes and short answers: neither texts nor prompts.
    ``row`` numbers the entries, whose ids may repeat; ``entries`` must be written, since it is read several times.
    """
    if not detail and hasattr(backend, "brief"):
        backend = backend.brief()
    user = T.fill_template(fv.ALIGNMENT_USER_PROMPT, name=F.col("name"), definition=F.col("text"))
    aligned = _by_model(ask_recorded(_model_requests(entries.select("row", user.alias("_user")), ["row"], fv.ALIGNMENT_SYSTEM_PROMPT, models), backend), ["row"], detail)
    sep = SEP.encode()
    prompt = PE.prompt_pieces(fv.DEFS_TOO_SIMILAR_USER_PROMPT, name_1="name_a", def_1="text_a", name_2="name_b", def_2="text_b")
    recipes = {"pair_key": ("md5", ["ref_a", sep, "text_a", sep, "ref_b", sep, "text_b"])} | {
        f"key_{m}": ("sha256", [SEP.join([name, fv.DEFS_TOO_SIMILAR_SYSTEM_PROMPT, ""]).encode(), *prompt]) for m, name in enumerate(models)}
    # a null name prints as None in a prompt
    sides = entries.withColumn("name", F.coalesce("name", F.lit("None"))).join(aligned, "row").select("id", "text", "ref", "row", "name", "answers")
    met = PE.digests(pairs, sides, recipes)
    met = materialize(met.select(
        F.monotonically_increasing_id().alias("pid"), "row_a", "row_b", "distance", "pair_key", F.col("name_a").alias("name_1"), F.col("name_b").alias("name_2"),
        F.col("answers_a").alias("a"), F.col("answers_b").alias("b"), F.array(*[f"key_{m}" for m in range(len(models))]).alias("keys")), "audit-pairs")
    user = T.fill_template(fv.NAMES_DISTINCT_USER_PROMPT, name_1=F.col("name_1"), name_2=F.col("name_2"))
    names = met.select("name_1", "name_2").distinct().select("name_1", "name_2", user.alias("_user"))
    names = _by_model(ask_recorded(_model_requests(names, ["name_1", "name_2"], fv.NAMES_DISTINCT_SYSTEM_PROMPT, models), backend), ["name_1", "name_2"], detail)
    both = met.join(materialize(names, "audit-names").withColumnRenamed("answers", "n"), ["name_1", "name_2"])

    def of(c: str) -> Column:
        return F.get(F.col(c), F.col("m"))

    each = both.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(len(models) - 1))))
    # round 2: only pairs whose round 1 succeeded with distinct names
    need2 = each.where((of("a")["n_ok"] + of("b")["n_ok"] + of("n")["n_ok"] == 3) & of("n")["answer"])
    second = _by_model(ask_recorded(need2.select("pid", "m", F.lower(F.hex(of("keys"))).alias("pkey")), backend), ["pid"], detail)
    every = both.drop("keys").join(second.withColumnRenamed("answers", "s"), "pid", "left").withColumn(
        "m", F.explode(F.sequence(F.lit(0), F.lit(len(models) - 1)))).withColumn("s", F.get(F.filter("s", lambda x: x["m"] == F.col("m")), F.lit(0)))
    sig = every.select("pid", "row_a", "row_b", "distance", F.lower(F.hex("pair_key")).alias("pair_id"), "name_1", "name_2",
                       F.element_at(F.array(*[F.lit(x) for x in models]), F.col("m") + 1).alias("model"),
                       *[c.alias(n) for role, x in zip(ROLES, (of("a"), of("b"), of("n"), F.col("s")))
                         for n, c in ((role, x["answer"]), (f"{role}_justification", x["justification"]), (f"{role}_error", x["error"]))])
    sig = _decided(sig, ["pid", "row_a", "row_b", "distance", "pair_id", "name_1", "name_2", "model"])
    return sig if detail else sig.withColumn("error", F.lit(None).cast("string"))


def remediation_rows(signals: DataFrame, backend) -> DataFrame:
    """L3 on the rows of :func:`audit_entries`: (pid, model, pair_id, term, definition)."""
    terms = T.terms_to_fix_expr("alignment_a", "alignment_b", "names_distinct", "defs_too_similar")
    todo = signals.filter(F.col("status") == "success").select("pid", "model", "pair_id", "name_1", "name_2", F.explode(terms).alias("term"))
    user = T.fill_template(fv.ISO_USER_PROMPT, term_name=F.when(F.col("term") == "A", F.col("name_1")).otherwise(F.col("name_2")))
    keyed = todo.select("pid", "model", "pair_id", "term", prompt_key(F.lit(fv.ISO_SYSTEM_PROMPT), user, F.col("model")).alias("pkey"))
    return _definitions(ask_recorded(keyed, backend), ["pid", "model", "pair_id", "term"])


def audit_entry_pairs(entries: DataFrame, pairs: DataFrame, backend) -> DataFrame:
    """L5 on prepared entries: the audit table of :func:`audit_candidates` with the entries' rows instead of their texts."""
    sig = materialize(audit_entries(entries, pairs, backend, [""], detail=False).select(
        "pid", "row_a", "row_b", "distance", "pair_id", "name_1", "name_2", "model", "status", "verdict", *ROLES), "audit-signals")
    fx = remediation_rows(sig, backend).groupBy("pid").agg(
        F.max(F.when(F.col("term") == "A", F.col("definition"))).alias("fix_a"),
        F.max(F.when(F.col("term") == "B", F.col("definition"))).alias("fix_b"))
    return sig.join(fx, "pid", "left").select(
        "row_a", "row_b", "distance", T.extract_verdict("verdict").alias("verdict"), F.coalesce("fix_a", F.lit("")).alias("llm_definition_a"),
        F.coalesce("fix_b", F.lit("")).alias("llm_definition_b"), "status")


def prepare_candidates(candidates: DataFrame) -> DataFrame:
    """L5 front: drop chemical pairs (P10, first), then structural ones (P11); strip the trailing
    bracket group of both names (P9); content-hash pair id (W3)."""
    kept = (candidates.filter(~T.is_chemical_pair("text_a", "text_b"))
            .filter(~T.is_structural_pair("text_a", "text_b")))
    return kept.select("*", pair_id_expr().alias("pair_id"),
                       T.strip_trailing_group("preferred_names_a").alias("name_1"), F.col("text_a").alias("def_1"),
                       T.strip_trailing_group("preferred_names_b").alias("name_2"), F.col("text_b").alias("def_2"))


def pair_id_expr() -> Column:
    """A content-hash id of a candidate pair (stable across runs and partitionings)."""
    return F.md5(F.concat_ws(SEP, F.coalesce(F.col("preferred_names_a"), F.lit("")), F.col("text_a"),
                             F.coalesce(F.col("preferred_names_b"), F.lit("")), F.col("text_b")))


def audit_candidates(candidates: DataFrame, backend, model: str | None = None,
                     remediate: bool = True, keep_pair_id: bool = False, texts: bool = True) -> DataFrame:
    """Candidate pairs → filters → names cleaned → audit → verdict → remediation.

    Output (the audit table, original names kept): ``distance, preferred_names_a, text_a,
    preferred_names_b, text_b, verdict, llm_definition_a, llm_definition_b, status``; a failed pair
    keeps its row with verdict UNKNOWN and status ``error``. Without ``texts`` the names and definitions of
    the pairs are left out, and not written in between when the backend answers by key.
    """
    # The prepared pairs feed both rounds, remediation and the final join: write them once to the
    # checkpoint directory instead of recomputing the radius join behind them for every use.
    pairs = _with_model(prepare_candidates(candidates), model)
    by_key = getattr(backend, "by_key", False)
    if by_key:
        pairs = prompt_keys(pairs)
    own = ["distance", "preferred_names_a", "text_a", "preferred_names_b", "text_b"] if texts or not by_key else ["distance"]
    # def_1 and def_2 are text_a and text_b: written once
    pairs = materialize(pairs.select(*own, "model", "pair_id", "name_1", "name_2", *(["keys"] if by_key else [])), "audit-pairs")
    if not by_key:
        pairs = pairs.withColumns({"def_1": F.col("text_a"), "def_2": F.col("text_b")})
    sig = audit_signals(pairs, backend, detail=False)
    if remediate:  # read twice
        sig = materialize(sig, "audit-signals")
    out = pairs.join(sig, ["model", "pair_id"])
    if remediate:
        fixes = remediation(pairs, sig, backend)
        fx = fixes.groupBy("model", "pair_id").agg(
            F.max(F.when(F.col("term") == "A", F.col("definition"))).alias("fix_a"),
            F.max(F.when(F.col("term") == "B", F.col("definition"))).alias("fix_b"))
        out = out.join(fx, ["model", "pair_id"], "left")
    else:
        out = out.withColumn("fix_a", F.lit(None).cast("string")).withColumn("fix_b", F.lit(None).cast("string"))
    cols = [*(own if texts else ["distance"]),
            T.extract_verdict("verdict").alias("verdict"),
            F.coalesce("fix_a", F.lit("")).alias("llm_definition_a"),
            F.coalesce("fix_b", F.lit("")).alias("llm_definition_b"), "status"]
    return out.select(*cols, *(["pair_id"] if keep_pair_id else []))


def verdict_counts(results: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Successful rows counted by (keys…, verdict)."""
    return (results.filter(F.col("status") == "success").groupBy(*keys, "verdict")
            .agg(F.count(F.lit(1)).alias("count")))


def single_prompt_requests(pairs: DataFrame, version: int | list[int]) -> DataFrame:
    """P20, prompt sets 1 to 3: one audit question a pair (role ``audit``), and the definition questions of
    the set: none in set 1, each term against the other in set 2, each term by itself in set 3. Several sets are
    made in one pass over the pairs."""
    versions = [version] if isinstance(version, int) else list(version)
    for v in versions:
        if v not in (1, 2, 3):
            raise ValueError(f"prompt sets 1 to 3 ask one question a pair, not {v}")
    ask = lambda v, role, system, template, **slots: F.struct(
        F.lit(v).alias("version"), F.lit(role).alias("role"), F.lit(system).alias("system"), T.fill_template(template, **slots).alias("user"))
    n1, n2 = F.col("name_1"), F.col("name_2")
    reqs = []
    for v in versions:
        reqs.append(ask(v, "audit", fv.SINGLE_AUDIT_SYSTEM_PROMPT, fv.SINGLE_AUDIT_USER_PROMPT, name_1=n1, def_1=F.col("def_1"), name_2=n2, def_2=F.col("def_2")))
        for role, own, other in (("definition_a", n1, n2), ("definition_b", n2, n1)):
            if v == 2:
                reqs.append(ask(v, role, fv.ANTAGONIST_SYSTEM_PROMPT, fv.ANTAGONIST_USER_PROMPT, term=own, antagonist=other))
            elif v == 3:
                reqs.append(ask(v, role, fv.ISO_SYSTEM_PROMPT, fv.ISO_USER_PROMPT, term_name=own))
    model = F.col("model") if "model" in pairs.columns else F.lit("").alias("model")
    r = pairs.select("pair_id", model, F.explode(F.array(*reqs)).alias("r")).select("pair_id", "model", "r.*")
    return r.withColumn("pkey", prompt_key(F.col("system"), F.col("user"), F.col("model")))


def run_counters(results: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Processed, success, error, with remediation (one row); with the ``candidates`` before the
    filters also ``skipped``, those that are chemical or structural."""
    if candidates is not None:
        out = T.is_chemical_pair("text_a", "text_b") | T.is_structural_pair("text_a", "text_b")
        return attach_row(run_counters(results), candidates.agg(F.count_if(out).alias("skipped")))
    has_fix = (F.coalesce(F.col("llm_definition_a"), F.lit("")) != "") | (F.coalesce(F.col("llm_definition_b"), F.lit("")) != "")
    return results.agg(F.count(F.lit(1)).alias("processed"),
                       F.count_if(F.col("status") == "success").alias("success"),
                       F.count_if(F.col("status") == "error").alias("error"),
                       F.count_if((F.col("status") == "success") & has_fix).alias("with_remediation"))


def expected_verdicts(ablation: DataFrame, expected: str = fv.EXPECTED_UNRELATED_VERDICT,
                      modes: list[str] | None = None) -> DataFrame:
    """For the unrelated test sets every success should be the expected verdict; pass rate."""
    modes = modes or fv.UNRELATED_TEST_SETS
    ok = ablation.filter(F.col("mode").isin(*modes) & (F.col("status") == "success"))
    return (ok.groupBy("model", "mode")
            .agg(F.count(F.lit(1)).alias("n_success"),
                 F.count_if(F.col("verdict") == expected).alias("n_expected"),
                 F.count_if(F.col("verdict") != expected).alias("n_violations"))
            .withColumn("pass_rate", F.col("n_expected") / F.col("n_success")))


def unexpected_verdicts(ablation: DataFrame, expected: str = fv.EXPECTED_UNRELATED_VERDICT, modes: list[str] | None = None) -> DataFrame:
    """The successful rows of the unrelated test sets with another verdict, one row each."""
    modes = modes or fv.UNRELATED_TEST_SETS
    return ablation.where(F.col("mode").isin(*modes) & (F.col("status") == "success") & (F.col("verdict") != expected)).select(
        "model", "mode", "tuple_id", "name_1", "name_2", "verdict")


def audit_tuple_set(tuples: DataFrame, backend, model: str | None = None, remediate: bool = True,
                    expected: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Audit a fixed set of tuples ``(tuple_id, name_1, def_1, name_2, def_2)`` — no candidate
    filters — and report per-tuple results plus one counter row (processed, success, error, with
    remediation, and, when ``expected`` is given, the successful rows with another verdict)."""
    pairs = materialize(_with_model(tuples.withColumnRenamed("tuple_id", "pair_id"), model), "tuple-set")
    sig = audit_signals(pairs, backend)
    res = pairs.select("model", "pair_id", "name_1", "name_2").join(sig, ["model", "pair_id"])
    if remediate:
        fx = (remediation(pairs, sig, backend).groupBy("model", "pair_id")
              .agg(F.map_from_entries(F.collect_list(F.struct("term", "definition"))).alias("proposed")))
        res = res.join(fx, ["model", "pair_id"], "left")
    else:
        res = res.withColumn("proposed", F.lit(None).cast("map<string,string>"))
    res = res.withColumnRenamed("pair_id", "tuple_id")
    has_fix = F.coalesce(F.size("proposed"), F.lit(0)) > 0
    ok = F.col("status") == "success"
    counters = res.agg(F.count(F.lit(1)).alias("processed"), F.count_if(ok).alias("success"),
                       F.count_if(~ok).alias("error"), F.count_if(ok & has_fix).alias("with_remediation"),
                       F.count_if(ok & (F.col("verdict") != F.lit(expected)) if expected else F.lit(False))
                       .alias("unexpected"))
    return res, counters
