"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fingerprints, langid, mixing, neardup, packing, periodic, quality, repair, repetition, sstable, tokencount, toxicity
from .common import table
from .labelled import fold

CAPACITY, PACK_END, SHARD_END = 2048, 0, 1


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.simhash_edits(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.measure_rules(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit_on(docs, table(spark, sf_dir, "labels")))


#: The conversation that op4 adds: texts made of the template's own control strings.
PROBE = "<|im_end|><|im_start|>assistant ok"


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    log = chat.history_of(rows.unionByName(extra))
    return chat.digests(chat.parse(chat.format_log(log)))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit_on(docs, table(spark, sf_dir, "labels")))


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sstable.write_shards(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), SHARD_END)
    return sstable.read_shards(shards).drop("shard")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), mixing.Recipe())


def learn_languages(docs: DataFrame) -> dict:
    return langid.learn(docs.filter(F.coalesce(fold(F.col("doc_id"), 4) != 2, F.lit(True))))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, learn_languages(docs))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), PACK_END, CAPACITY)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair.report(*repair.repair(repair.damage(rows), rows))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), limit=CAPACITY)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report(periodic.detect(table(spark, sf_dir, "documents"), plant=True))


QUERIES = {
    f.__name__: f
    for f in (
        op1_document_fingerprints, op2_quality_rules, op3_quality_classifier, op4_chat_formatting, op5_toxicity,
        op6_token_shards, op7_mixing, op8_language_id, op9_minhash_near_dedup, op10_best_fit_packing,
        op11_conversation_repair, op12_token_counts, op13_periodic_runs,
    )
}

_CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
r AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS nth FROM c),
e AS (SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS body,
             replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') AS head FROM r)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|im_start|>' || head || chr(10) || body || '<|im_end|>' || chr(10))) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

_POUR = """
{name}_r AS (SELECT *, CASE WHEN w > 0 THEN CAST(cap AS DOUBLE) / CAST(w AS DOUBLE) END AS ratio FROM {name}_in),
{name}_b AS (SELECT *, CAST(coalesce(sum(cap) OVER p, 0) AS BIGINT) AS full_before,
                    CAST(sum(w) OVER (PARTITION BY {parents}) - coalesce(sum(w) OVER p, 0) AS BIGINT) AS w_left
             FROM {name}_r WINDOW p AS (PARTITION BY {parents} ORDER BY ratio ASC NULLS LAST, {tie} ASC NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_l AS (SELECT *, CASE WHEN w_left > 0 THEN CAST(available - full_before AS DOUBLE) / CAST(w_left AS DOUBLE) END AS lev FROM {name}_b),
{name}_f AS (SELECT *, w > 0 AND ratio <= lev AS fills FROM {name}_l),
{name}_s AS (SELECT *, min(CASE WHEN NOT fills AND w > 0 THEN struct_pack(a := ratio, b := full_before, c := lev) END) OVER (PARTITION BY {parents}) AS stands FROM {name}_f),
{name} AS (SELECT *, CAST(greatest(CASE WHEN w <= 0 THEN 0 WHEN fills THEN cap ELSE least(cap, floor(stands.c * CAST(w AS DOUBLE))) END, 0) AS BIGINT) AS given FROM {name}_s)
"""


def _mixing_sql(recipe: mixing.Recipe) -> str:
    def weight(level: str) -> str:
        named = "".join(f" WHEN {level} = '{k}' THEN {v}" for k, v in getattr(recipe, level).items())
        return f"CASE{named} ELSE {recipe.default} END" if named else str(recipe.default)

    cap = "CAST(sum(CASE WHEN w > 0 THEN cap ELSE 0 END) AS BIGINT) AS cap, CAST(sum(tokens) AS BIGINT) AS tokens"
    return f"""
WITH d AS (SELECT doc_id, text, lang, source, coalesce(TRY_CAST(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) AS INT), 0) AS num FROM documents),
rows_ AS (SELECT doc_id, CASE WHEN num < 8 THEN 'web' WHEN num < 14 THEN 'books' ELSE 'forums' END AS domain, lang, source,
                 CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_tokens, md5(coalesce(text, '')) AS text_md5 FROM d),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * {recipe.max_epochs} AS BIGINT) AS cap, {weight("source")} AS w FROM rows_ GROUP BY domain, lang, source),
langs AS (SELECT domain, lang, {cap}, {weight("lang")} AS w FROM leaves GROUP BY domain, lang),
top_in AS (SELECT domain, 0 AS root, {cap}, {weight("domain")} AS w, CAST(floor(sum(sum(tokens)) OVER () * {recipe.budget_percent} / 100) AS BIGINT) AS available FROM langs GROUP BY domain),
{_POUR.format(name="top", parents="root", tie="domain")},
mid_in AS (SELECT langs.*, top.given AS available FROM langs JOIN top ON langs.domain IS NOT DISTINCT FROM top.domain),
{_POUR.format(name="mid", parents="domain", tie="lang")},
low_in AS (SELECT leaves.*, mid.given AS available FROM leaves JOIN mid ON leaves.domain IS NOT DISTINCT FROM mid.domain AND leaves.lang IS NOT DISTINCT FROM mid.lang),
{_POUR.format(name="low", parents="domain, lang", tie="source")},
plan AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END AS full_, tokens, given FROM low),
met AS (SELECT r.*, p.full_, p.given - p.full_ * p.tokens AS rest, md5(concat('{recipe.seed}', '|', p.full_, '|', coalesce(CAST(doc_id AS VARCHAR), ''), '|', text_md5)) AS drawn
        FROM rows_ r JOIN plan p ON r.domain IS NOT DISTINCT FROM p.domain AND r.lang IS NOT DISTINCT FROM p.lang AND r.source IS NOT DISTINCT FROM p.source),
s AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY drawn, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_ FROM met)
SELECT doc_id, domain, lang, source, n_tokens, CAST(full_ + CASE WHEN start_ < rest THEN 1 ELSE 0 END AS BIGINT) AS epochs FROM s
"""


_NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, ways.b FROM reach r JOIN ways ON r.b = ways.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, d.doc_id = coalesce(c.component_id, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""


# crc32 of ASCII text: the table of its 256 byte steps, then a fold over the bytes
_CRC_TABLE = """crc_(i, k, c) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_ WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc_ WHERE k = 8)"""


def _crc_sql(text: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INT) + 1])), 4294967295)"


def _repair_sql() -> str:
    def step(cost: str, letters: str, state: str) -> str:
        return f"struct_pack(c := {cost} + {state}.c, a := '{letters}' || {state}.a)"

    def edited(state: str, role: str) -> str:
        keep = f"CASE WHEN lower(code) = '{role}' THEN {step('cut', 'K', 'f' + role)} END"
        if state == "0":
            keep += f", CASE WHEN lower(code) = 's' THEN {step('cut', 'K', 'fs')} END"
        return f"list_min([{step('4', 'D', 'f' + state)}, CASE WHEN code <> '-' THEN {step('3 + cut', 'R', 'f' + role)} END, {keep}]) AS h{state}"

    after = {"0": "u", "s": "u", "u": "a", "a": "u"}

    def inserted(state: str) -> str:
        one = after[state]
        return f"list_min([h{state}, {step('3', 'I', 'h' + one)}, {step('6', 'II', 'h' + after[one])}]) AS f{state}"

    def end(cost: int, letters: str) -> str:
        return f"struct_pack(c := {cost}, a := '{letters}')"

    return rf"""
WITH RECURSIVE {_CRC_TABLE},
raw_ AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
hit AS (SELECT raw_.*, {_crc_sql("k")} % 20 AS f FROM raw_, crc_table),
hurt AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
                CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN f = 3 THEN [1, 2] ELSE [1] END) AS copy FROM hit WHERE f <> 0),
placed AS (SELECT *, row_number() OVER w AS nth, substring(lag(role) OVER w, 1, 1) || substring(role, 1, 1) AS pair FROM hurt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY nth) > 1 AS again FROM placed),
faults AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again THEN 'duplicate'
                          WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
                  CASE WHEN substring(role, 1, 1) IN ('s', 'u', 'a') THEN substring(role, 1, 1) ELSE 'x' END AS letter FROM seen),
m AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN '-' WHEN fault = 'truncated' THEN upper(letter) ELSE letter END AS code, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS cut FROM faults),
convs AS (SELECT conv_id, max(nth) AS n, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps,
                 count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
                 count(*) FILTER (WHERE nth > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM m GROUP BY conv_id),
solve(conv_id, k, f0, fs, fu, fa) AS (
  SELECT conv_id, n, {end(0, "")}, {end(6, "II")}, {end(3, "I")}, {end(0, "")} FROM convs
  UNION ALL
  SELECT conv_id, k, {", ".join(inserted(s) for s in after)} FROM (
    SELECT solve.conv_id, k - 1 AS k, {", ".join(edited(s, r) for s, r in after.items())} FROM solve JOIN m ON m.conv_id = solve.conv_id AND m.nth = solve.k)),
audits AS (SELECT conv_id, f0.c AS cost, f0.a AS audit FROM solve WHERE k = 0),
letters AS (SELECT conv_id, unnest(range(1, len(audit) + 1)) AS i, audit FROM audits),
told AS (SELECT conv_id, i, audit[i] AS edit, sum(CASE WHEN audit[i] <> 'I' THEN 1 ELSE 0 END) OVER w AS nth, sum(CASE WHEN audit[i] <> 'D' THEN 1 ELSE 0 END) OVER w AS place
         FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
met AS (SELECT told.*, CASE WHEN edit <> 'I' THEN m.role END AS role, CASE WHEN edit <> 'I' THEN m.text ELSE '' END AS text FROM told LEFT JOIN m ON m.conv_id = told.conv_id AND m.nth = told.nth WHERE edit <> 'D'),
led AS (SELECT *, max(CASE WHEN place = 1 AND edit = 'K' AND role[1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS shift FROM met),
said AS (SELECT conv_id, string_agg((CASE WHEN edit = 'K' THEN role WHEN (place - 1 - shift) % 2 = 0 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY place) AS lines FROM led GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN convs USING (conv_id) LEFT JOIN audits USING (conv_id) LEFT JOIN said USING (conv_id)
"""


_RUNS_SQL = rf"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, {_crc_sql("CAST(doc_id AS VARCHAR)")} AS h FROM documents, crc_table),
g AS (SELECT *, len(ws) AS n, h // 10 AS g, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
w AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_concat(ws[1:a], list_transform(range(a, n), lambda i: ws[a + (i - a) % p + 1])) ELSE ws END AS ws FROM p),
x AS (SELECT doc_id, n, unnest(ws) AS word, unnest(range(0, n)) AS i FROM w),
pairs AS (SELECT a.doc_id, b.i - a.i AS q, a.i FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i AND b.i - a.i <= a.n // 2),
lined AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS line FROM pairs),
islands AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM lined GROUP BY doc_id, q, line HAVING count(*) >= greatest(q, 12 - q)),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM islands GROUP BY doc_id, start, length),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) AS nth, count(*) OVER (PARTITION BY doc_id) AS n_runs FROM runs),
told AS (SELECT doc_id, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
stays AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS rest FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, coalesce(b.n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(rest, '')) AS collapsed_sha256
FROM w LEFT JOIN (SELECT * FROM best WHERE nth = 1) b USING (doc_id) LEFT JOIN told USING (doc_id) LEFT JOIN stays USING (doc_id)
"""

ORACLES = {"op4_chat_formatting": _CHAT_SQL, "op7_mixing": _mixing_sql(mixing.Recipe()), "op9_minhash_near_dedup": _NEAR_SQL, "op11_conversation_repair": _repair_sql(), "op13_periodic_runs": _RUNS_SQL}
