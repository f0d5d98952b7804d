"""Registered queries of the operators, with their SQL where DuckDB can express the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")




@query("op9_quality_rules", r"""
with d as (select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
lines as (select doc_id, l, i from (select doc_id, unnest(string_split(t, chr(10))) l, generate_subscripts(string_split(t, chr(10)), 1) i from d)
  where regexp_matches(l, '[^\x20\x09-\x0D]')),
dl as (select doc_id, sum(length(l)) lc, count(*) filter (rn > 1) nd, coalesce(sum(length(l)) filter (rn > 1), 0) dc
  from (select *, row_number() over (partition by doc_id, l order by i) rn from lines) group by doc_id),
p as (select doc_id, unnest(w) word, generate_subscripts(w, 1) pos from d),
n as (select unnest(range(5, 11)) n),
g as (select doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') k
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from d, n where len(w) >= n)),
r as (select doc_id, n, i, count(*) over (partition by doc_id, n, k) c, row_number() over (partition by doc_id, n, k order by i) rn from g),
rep as (select doc_id, count(distinct pos) nr from (select doc_id, unnest(range(i, i + 5)) pos from r where n = 5 and c > 1) group by doc_id),
late as (select distinct doc_id, n, pos from (select doc_id, n, unnest(range(i, i + n)) pos from r where rn > 1)),
lc as (select doc_id, n, sum(length(word)) c from late join p using (doc_id, pos) group by all),
wc as (select doc_id, sum(length(word)) c from p group by doc_id),
bad as (select distinct lc.doc_id from lc join wc using (doc_id) where 100 * lc.c > (20 - n) * wc.c),
m as (select doc_id, len(w)::bigint n_words, coalesce(wc.c, 0)::bigint word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint n_symbols,
  coalesce(nd, 0)::bigint n_dup_lines, coalesce(nr, 0)::bigint n_repeat_words, coalesce(dc, 0) dc, coalesce(lc, 0) lc, bad.doc_id is not null bad
  from d left join dl using (doc_id) left join rep using (doc_id) left join wc using (doc_id) left join bad using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words or bad or 100 * dc > 20 * lc or 100 * n_symbols > 20 * n_words) as kept
from m
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op8_decontamination", r"""
with d as (select doc_id, regexp_extract_all(lower_az(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select item_id, regexp_extract_all(lower_az(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
win as (select distinct item_id, least(len(w), 13) n, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') k
  from (select item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) i from b where len(w) > 0)),
sizes as (select distinct n from win),
g as (select doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') k
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from d, sizes where len(w) >= n)),
hit as (select doc_id, n, i, item_id from g join win using (n, k)),
h as (select doc_id, count(distinct pos) n_hit from (select doc_id, unnest(range(i, i + n)) pos from (select distinct doc_id, n, i from hit)) group by doc_id),
it as (select doc_id, count(*) n_items, string_agg(id, ',' order by id) ids from (select distinct doc_id, item_id::varchar id from hit) group by doc_id)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
  sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * n_hit >= len(w) contaminated
from d left join h using (doc_id) left join it using (doc_id)
""".replace("lower_az(coalesce(text, ''))",
            "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"))
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import decontaminate

    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


@query("op1_sentencepiece")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_bpe import encode_decode, token_digests

    return token_digests(encode_decode(table(spark, sf_dir, "documents"), tokenizer_path()))


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op5_sharding")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(table(spark, sf_dir, "documents"), 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def remainder(n: int, col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(n))


@query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify, sample

    docs = table(spark, sf_dir, "documents")
    found = identify(docs, sample(docs.where(remainder(4) != 2)))
    return found.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(remainder(5) != 0))
    return score(docs, model).select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score",
                                     (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op10_lm_scoring")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lmscore import score_texts

    found = score_texts(table(spark, sf_dir, "documents"), remainder(7) != 2)
    return found.select("doc_id", F.coalesce(remainder(7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known",
                        "train_tokens", "base_score", "score")


@query("op6_ngram_jaccard")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


@query("op2_suffix_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import digests, remove_repeats

    return digests(remove_repeats(table(spark, sf_dir, "documents")))


@query("op3_substring_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .debruijn_dedup import digests, remove_repeats

    return digests(remove_repeats(table(spark, sf_dir, "documents")))


@query("op11_exact_dedup", """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept,
  sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


@query("op13_prefix_trie", r"""
with crc as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) t),
turns as (select conv_id c, coalesce(role, '') r, coalesce(text, '') x,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) p
  from conversations where conv_id is not null),
own as (select c, list({'r': r, 'x': x} order by p) s from turns group by c),
h as (select c, s, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(c::varchar, ''), lambda y: ascii(y)::bigint)),
    lambda a, b: xor(crc.t[1 + (xor(a, b) & 255)], a >> 8))) % 4 h from own, crc),
reb as (select h.c, list_concat(coalesce(b.s[1:h], h.s[1:0]), h.s[h + 1:]) s from h left join own b on b.c = h.c - h.c % 20),
pre as (select c, len(s) n, d, s[1:d] k from (select c, s, unnest(range(len(s) + 1)) d from reb)),
node as (select k, d, min(c) c, count(*) n, coalesce(string_agg(c::varchar, ',' order by c) filter (n = d), '') e from pre group by k, d),
own_sums as (select a.k, a.d, a.c, a.n, a.e, p.c pc, count(ch.k) nc,
    (a.n - 1) * coalesce(len(regexp_extract_all(a.k[a.d].x, '[^ 	-
]+')), 0) sv
  from node a left join node p on a.d > 0 and p.k = a.k[1:a.d - 1] and p.d = a.d - 1
    left join node ch on ch.d = a.d + 1 and ch.k[1:a.d] = a.k
  group by a.k, a.d, a.c, a.n, a.e, p.c),
sub as (select k, sum(l)::bigint l, sum(sv)::bigint sv
  from (select k0[1:g] k, (nc = 0)::int l, sv from (select k k0, nc, sv, unnest(range(d + 1)) g from own_sums)) group by k)
select c conv_id, d::bigint as "depth", pc parent_conv_id, n n_convs, nc n_children, sub.l n_leaves, sub.sv saved_tokens, sha256(e) ends_sha256
from own_sums join sub using (k)
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import trie

    return trie(table(spark, sf_dir, "conversations"))


@query("op12_collocations", r"""
with d as (select row_number() over () id, coalesce(lang, 'und') lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
p as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) p from d),
w as (select lang, regexp_extract_all(p, '[^\x20\x09]+') w from p),
f as (select lang, g, count(*) f from (select lang, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) g
  from w, (select unnest([1, 2, 3]) k) where len(w) >= k) group by lang, g),
n as (select lang, sum(len(w))::bigint n from w group by lang),
cut as (select c.lang, c.g, c.f a, l.f l, r.f r, k, (1000000::hugeint * c.f * c.f) // (l.f::hugeint * r.f) s
  from (select *, unnest(range(1, len(g))) k from f where len(g) > 1 and f >= 10) c
    join f l on l.lang = c.lang and l.g = c.g[1:k] join f r on r.lang = c.lang and r.g = c.g[k + 1:]),
best as (select * from cut qualify row_number() over (partition by lang, g order by s, k) = 1),
long as (select lang, part, max(f) m from (select lang, f, unnest([g[1:2], g[2:3]]) part from f where len(g) = 3 and f >= 10) group by lang, part),
kept as (select b.* from best b left join long on long.lang = b.lang and long.part = b.g where m is null or 100 * m < 50 * a),
named as (select lang, array_to_string(g, ' ') phrase, a, l, r, s::bigint score from kept)
select lang, rank, phrase, a, l, r, n, score
from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) rank from named) join n using (lang) where rank <= 2000
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))
