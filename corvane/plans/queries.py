"""Registered queries over the standard tables, with the same result as DuckDB SQL.

Responses are stand-ins: a document answers the benchmark item of its number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core_metrics import TOKEN_METRICS, cosine_similarity, count_columns, prepared_columns, token_columns, token_metric, token_scores
from ..functions.dialect import Dialect, DuckSql, SparkSql
from ..functions.ngram import NGRAM_METRICS
from ..functions.ngram_sql import Stems, ngram_scores
from ..functions.registry import MetricRegistry, metric_sql, module_scores, shared_columns
from ..functions.task_metrics import MODULES
from ..operators import paths, permute, prompts, prune, sampling
from ..operators.training import TrainingRequest, examples, formatted, split_examples
from ..plans import evaluate, grid, inference, states, summary
from ..sources import readers, sinks
from ..sources.shared import new_path, written
from ..streaming import live
from .cases import CASES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if c in columns else F.col(c) for c in df.columns])


# ---- responses --------------------------------------------------------------------------------------


def question_values(d: Dialect) -> str:
    """A question of eight words, four choices and the right one, from the benchmark text ``b`` and the response ``a``."""
    w = d.words("b")
    question = [d.at(w, i) for i in range(8)]
    blank = lambda x: f"coalesce({x}, '')"
    items = [f"concat_ws(' ', {', '.join(map(blank, question))})", *[blank(d.at(w, i)) for i in (2, 5)], d.first("a", r"^\s*[^\s]+\s+([^\s]+)"), blank(d.at(w, 3)), blank(d.at(w, 2))]
    return f"array({', '.join(items)})" if isinstance(d, SparkSql) else f"[{', '.join(items)}]"


_RESPONSES = f"""
SELECT doc_id, a AS response, b AS expected_output, setup, model, prompt, success, processing_time, {question_values(DuckSql())} AS question_values
FROM (SELECT d.doc_id, d.text AS a, i.text AS b, d.lang AS setup, d.source AS model, concat('q', CAST(coalesce(l.quality, 9) AS VARCHAR)) AS prompt,
             coalesce(l.toxic, 0) = 0 AS success, d.n_chars / 1000.0 AS processing_time
      FROM documents d JOIN benchmark i ON i.item_id = d.doc_id % (SELECT count(*) FROM benchmark) LEFT JOIN labels l ON l.doc_id = d.doc_id)
"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as responses to benchmark items; setup is the language, model the source, prompt the quality label."""
    docs, items, labels = (table(spark, sf_dir, t) for t in ("documents", "benchmark", "labels"))
    n = items.agg(F.count("*").alias("n_items"))
    asked = docs.crossJoin(F.broadcast(n)).withColumn("item_id", F.col("doc_id") % F.col("n_items")).join(items.select("item_id", F.col("text").alias("b")), "item_id")
    asked = asked.join(labels, "doc_id", "left")
    base = asked.select("doc_id", F.col("text").alias("a"), "b", F.col("lang").alias("setup"), F.col("source").alias("model"), F.concat(F.lit("q"), F.coalesce(F.col("quality"), F.lit(9)).cast("string")).alias("prompt"), (F.coalesce(F.col("toxic"), F.lit(0)) == 0).alias("success"), (F.col("n_chars") / 1000.0).alias("processing_time"))
    return base.select("doc_id", F.col("a").alias("response"), F.col("b").alias("expected_output"), "setup", "model", "prompt", "success", "processing_time", F.expr(question_values(SparkSql())).alias("question_values"))


def _duck_stages(source: str, stages: list[dict[str, str]]) -> str:
    """SQL with further columns, each stage over those before it."""
    for stage in stages:
        source = f"SELECT *, {', '.join(f'{sql} AS {name}' for name, sql in stage.items())} FROM ({source})"
    return source


def duck_token_scores(source: str, keys: str) -> str:
    d = DuckSql()
    two = _duck_stages(source, [*prepared_columns(d), token_columns(d), count_columns(d)])
    return f"SELECT {keys}, {', '.join(f'{token_metric(d, m)} AS {m}' for m in TOKEN_METRICS)}, CASE WHEN ok THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS generation_failed FROM ({two})"


KEYS = "doc_id, setup, model, prompt"
_SCORES = duck_token_scores(_RESPONSES, KEYS)
_VALID = f"(SELECT * FROM ({_SCORES}) WHERE generation_failed = 0)"
_LONG = " UNION ALL ".join(f"SELECT setup, prompt, model, '{m}' AS metric, {m} AS value FROM valid" for m in TOKEN_METRICS)
_STATS_SQL = f"""
WITH valid AS MATERIALIZED {_VALID}, long AS ({_LONG}),
stats AS (SELECT setup, prompt, model, concat(setup, '__', model, '__', prompt) AS experiment_name, metric, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max, median(value) AS median
          FROM long GROUP BY setup, prompt, model, metric)
"""


def experiment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = token_scores(responses(spark, sf_dir), ["doc_id", "setup", "model", "prompt"])
    stats = evaluate.aggregate(scored, ["setup", "prompt", "model"])
    return stats.withColumn("experiment_name", F.concat_ws("__", "setup", "model", "prompt"))


def numbered_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics rounded to nine places, so that ties are the same everywhere, in the order of experiment names."""
    return experiment_stats(spark, sf_dir).withColumn("mean", F.round("mean", 9))


def _rounded_sql(columns: list[str]) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


@query(f"SELECT {KEYS}, {_rounded_sql(TOKEN_METRICS)}, generation_failed FROM ({_SCORES})")
def core_token_scores(spark, sf_dir):
    return rounded(token_scores(responses(spark, sf_dir), KEYS.split(", ")), *TOKEN_METRICS)


@query(f"{_STATS_SQL} SELECT setup, prompt, model, experiment_name, metric, {_rounded_sql(evaluate.STATS)} FROM stats")
def core_experiment_stats(spark, sf_dir):
    return rounded(experiment_stats(spark, sf_dir), *evaluate.STATS)


@query(f"SELECT setup, prompt, model, count(*) AS num_samples, count(*) FILTER (generation_failed = 0) AS num_valid, count(*) FILTER (generation_failed > 0) AS num_failed FROM ({_SCORES}) GROUP BY ALL")
def core_batch_counts(spark, sf_dir):
    return evaluate.batch_counts(token_scores(responses(spark, sf_dir), KEYS.split(", ")), ["setup", "prompt", "model"])


def _duck_ngrams(places: int = 6) -> str:
    """n-gram metrics by relations: every gram a row, counted by side; stems of distinct words joined."""
    # The patterns of BLEU's tokenisation, in this engine's syntax.
    text = "' ' || replace(replace(replace(replace(replace(replace(replace(t, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' '), '&quot;', '\"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>') || ' '"
    for pattern, by in ((r"([\{-~\[-` -&\(-\+:-@/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "), (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        text = f"regexp_replace({text}, '{pattern}', '{by}', 'g')"
    d = DuckSql()
    grams = lambda source, kind, n: f"SELECT doc_id, side, '{kind}{n}' AS kind, unnest(list_transform(range(1, len(ws) - {n - 2}), lambda i: array_to_string(ws[i:i + {n - 1}], ' '))) AS gram FROM {source} WHERE len(ws) >= {n}"
    orders = [f"coalesce(max(hits) FILTER (kind = 'b{n}'), 0) AS h{n}, coalesce(max(ours) FILTER (kind = 'b{n}'), 0) AS t{n}" for n in range(1, 5)]
    zero = lambda n: " + ".join(f"CASE WHEN t{k} > 0 AND h{k} = 0 THEN 1 ELSE 0 END" for k in range(1, n + 1))
    logs = " + ".join(f"CASE WHEN t{n} <= 0 THEN 0 WHEN h{n} > 0 THEN ln(h{n} / t{n}) ELSE -ln(pow(2, {zero(n)}) * t{n}) END" for n in range(1, 5))
    bleu = f"CASE WHEN h1 + h2 + h3 + h4 = 0 THEN 0.0 ELSE exp(least(0.0, 1 - m / t1) + ({logs}) / least(t1, 4)) END"
    rouge = lambda n: f"coalesce(max(2.0 * hits / (ours + theirs)) FILTER (kind = 'r{n}'), 0.0)"
    guard = lambda v: f"round(CASE WHEN NOT ok THEN 0.0 WHEN r = '' AND e = '' THEN 1.0 WHEN r = '' OR e = '' THEN 0.0 ELSE {v} END, {places})"
    return f"""
WITH p AS MATERIALIZED ({_duck_stages(_RESPONSES, prepared_columns(d))}),
sides AS (SELECT doc_id, 'a' AS side, r AS t FROM p WHERE ok UNION ALL SELECT doc_id, 'b', e FROM p WHERE ok),
tokens AS MATERIALIZED (SELECT doc_id, side, {d.words('x')} AS ws FROM (SELECT doc_id, side, {text} AS x FROM sides)),
plain AS MATERIALIZED (SELECT doc_id, side, regexp_extract_all(lower(t), '[a-z0-9]+') AS ws FROM sides),
stems AS MATERIALIZED (SELECT word, {Stems(spark=False).stem('word')} AS stem FROM (SELECT DISTINCT unnest(ws) AS word FROM plain)),
stemmed AS MATERIALIZED (SELECT doc_id, side, list(stem ORDER BY i) AS ws FROM (SELECT doc_id, side, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM plain) JOIN stems USING (word) GROUP BY doc_id, side),
grams AS ({' UNION ALL '.join([*(grams('tokens', 'b', n) for n in range(1, 5)), grams('stemmed', 'r', 1), grams('stemmed', 'r', 2)])}),
counted AS (SELECT doc_id, kind, gram, count(*) FILTER (side = 'a') AS a, count(*) FILTER (side = 'b') AS b FROM grams GROUP BY doc_id, kind, gram),
totals AS (SELECT doc_id, kind, sum(least(a, b)) AS hits, sum(a) AS ours, sum(b) AS theirs FROM counted GROUP BY doc_id, kind),
wide AS (SELECT doc_id, {', '.join(orders)}, coalesce(max(theirs) FILTER (kind = 'b1'), 0) AS m, {rouge(1)} AS r1, {rouge(2)} AS r2 FROM totals GROUP BY doc_id)
SELECT p.doc_id, {guard(bleu)} AS bleu, {guard('coalesce(r1, 0.0)')} AS rouge1_f, {guard('coalesce(r2, 0.0)')} AS rouge2_f FROM p LEFT JOIN wide ON wide.doc_id = p.doc_id"""


@query(_duck_ngrams())
def core_ngram_scores(spark, sf_dir):
    """BLEU, ROUGE-1 and ROUGE-2, in the JVM."""
    return rounded(ngram_scores(spread_responses(spark, sf_dir), ["doc_id"], with_subsequence=False), *NGRAM_METRICS[:3])


@query()
def core_subsequence_scores(spark, sf_dir):
    """ROUGE-L, by longest common subsequences of whole texts."""
    return rounded(ngram_scores(spread_responses(spark, sf_dir), ["doc_id"]).select("doc_id", "rougeL_f"), "rougeL_f")


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS semantic_similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def core_semantic_similarity(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    after = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return vectors.join(after, "vec_id").select("vec_id", F.round(cosine_similarity("embedding", "other"), 6).alias("semantic_similarity"))


# ---- task metrics --------------------------------------------------------------------------------------


def _duck_text(text: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if text is None else DuckSql().lit(text)


def _duck_cases() -> str:
    rows = [f"({-1 - i}, {_duck_text(r)}, {_duck_text(e)}, {'CAST(NULL AS VARCHAR[])' if q is None else DuckSql().text_array(q)}, {str(ok).upper()})" for i, (r, e, q, ok) in enumerate(CASES)]
    return f"SELECT CAST(i AS BIGINT) AS doc_id, response, expected_output, question_values, success FROM (VALUES {', '.join(rows)}) t(i, response, expected_output, question_values, success)"


def case_rows(spark: SparkSession) -> DataFrame:
    rows = [(-1 - i, r, e, q, ok) for i, (r, e, q, ok) in enumerate(CASES)]
    return spark.createDataFrame(rows, "doc_id long, response string, expected_output string, question_values array<string>, success boolean")


def spread_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses dealt to all tasks by their id: a small table is one row group, and what follows is far dearer than moving it."""
    return dealt(responses(spark, sf_dir))


def dealt(rows: DataFrame) -> DataFrame:
    """By doc_id to a fixed number of tasks: one that is left to sizes comes to little more tasks than cores, and the last of them run alone."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")


def task_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hand-written cases, and the responses of all languages and of none."""
    return spread_responses(spark, sf_dir).select("doc_id", "response", "expected_output", "question_values", "success").unionByName(case_rows(spark))


_TASK_ROWS = f"SELECT doc_id, response, expected_output, question_values, success FROM ({_RESPONSES}) UNION ALL {_duck_cases()}"


def _task_query(module: str) -> None:
    d = DuckSql()
    metrics = ", ".join(f"round({metric_sql(d, module, m)}, 6) AS {m}" for m in MODULES[module])
    source = _duck_stages(_TASK_ROWS, [*prepared_columns(d), *shared_columns(d, module)])

    @query(f"SELECT doc_id, {metrics} FROM ({source})", f"task_{module}")
    def run(spark, sf_dir):
        return rounded(module_scores(task_rows(spark, sf_dir), module, ["doc_id"]), *MODULES[module])


for _module in MODULES:
    _task_query(_module)


@query()
def task_registered_function(spark, sf_dir):
    """A function added by a user, beside a setup's own metrics."""
    registry = MetricRegistry()
    registry.register("response_length_share", lambda r: len(r["response"]) / max(1, len(r["expected_output"])))
    return registry.scores(task_rows(spark, sf_dir), "pubmedqa_reasoning_free", ["doc_id"])


# ---- summaries --------------------------------------------------------------------------------------------

_NINE = f"{_STATS_SQL}, nine AS (SELECT * REPLACE (round(mean, 9) AS mean) FROM stats)"


@query(f"{_STATS_SQL} SELECT setup, prompt, metric, count(DISTINCT experiment_name) AS num_experiments, round(avg(mean), 4) AS mean FROM stats GROUP BY ALL")
def summary_group_means(spark, sf_dir):
    return summary.group_means(experiment_stats(spark, sf_dir), ["setup", "prompt"])


@query(f"{_STATS_SQL} SELECT setup, prompt, model, count(DISTINCT experiment_name) AS num_experiments, round(avg(mean), 4) AS mean FROM stats WHERE metric = 'f1_score' GROUP BY ROLLUP (setup, prompt, model)")
def summary_rollup(spark, sf_dir):
    return summary.rolled_up(experiment_stats(spark, sf_dir).where("metric = 'f1_score'"))


@query(f"""{_STATS_SQL} SELECT count(DISTINCT experiment_name) AS total_experiments, count(DISTINCT setup) AS total_setups, count(DISTINCT setup || '/' || prompt) AS total_prompts, count(DISTINCT model) AS total_models,
array_to_string(list_sort(list(DISTINCT setup)), ',') AS setups, array_to_string(list_sort(list(DISTINCT model)), ',') AS models FROM stats""")
def summary_counts(spark, sf_dir):
    return summary.counts(experiment_stats(spark, sf_dir)).withColumn("setups", F.array_join("setups", ",")).withColumn("models", F.array_join("models", ","))


@query(f"{_STATS_SQL} SELECT setup, array_to_string(list_sort(list(DISTINCT prompt)), ',') AS prompts FROM stats GROUP BY setup")
def summary_prompts_per_setup(spark, sf_dir):
    return summary.prompts_per_setup(experiment_stats(spark, sf_dir)).withColumn("prompts", F.array_join("prompts", ","))


_FIRST = "row_number() OVER (PARTITION BY metric ORDER BY mean DESC, experiment_name)"


@query(f"{_NINE} SELECT metric, experiment_name, setup, prompt, model, round(mean, 4) AS score FROM (SELECT *, {_FIRST} AS k FROM nine) WHERE k = 1")
def summary_best_performers(spark, sf_dir):
    stats = numbered_stats(spark, sf_dir)
    order = stats.select("experiment_name").distinct()
    order = sampling.with_row_index(order, "experiment_name", "ord")  # the order of input
    return summary.best_performers(stats.join(order, "experiment_name"))


@query(f"{_NINE} SELECT metric, experiment_name, round(mean, 6) AS mean, {_FIRST} AS rank FROM nine")
def summary_ranked(spark, sf_dir):
    return rounded(summary.ranked(numbered_stats(spark, sf_dir)).select("metric", "experiment_name", "mean", F.col("rank").cast("long").alias("rank")), "mean")


_OVER_MEANS = ", ".join(f"round({f}(mean), 6) AS {name}" for f, name in (("avg", "mean"), ("stddev_pop", "std"), ("min", "min"), ("max", "max"), ("median", "median")))


@query(f"{_STATS_SQL}, means AS (SELECT metric, mean FROM stats) SELECT metric, {_OVER_MEANS} FROM means WHERE metric IN ('f1_score', 'exact_match') GROUP BY metric")
def summary_global_stats(spark, sf_dir):
    return rounded(summary.global_stats(experiment_stats(spark, sf_dir)), *evaluate.STATS)


_TWO = ["en__src1__q9", "en__src2__q9", "en__missing__q9"]


@query(f"""{_NINE}, wide AS (SELECT metric, {', '.join(f"round(coalesce(max(mean) FILTER (experiment_name = '{e}'), 0), 6) AS \"{e}\"" for e in _TWO)} FROM nine WHERE experiment_name IN ({', '.join(f"'{e}'" for e in _TWO)}) GROUP BY metric)
SELECT *, CASE greatest({', '.join(f'"{e}"' for e in _TWO)}) {' '.join(f"WHEN \"{e}\" THEN '{e}'" for e in _TWO)} END AS best FROM wide""")
def summary_compared(spark, sf_dir):
    return rounded(summary.compared(numbered_stats(spark, sf_dir).withColumn("mean", F.round("mean", 6)), _TWO), *_TWO)


@query(f"{_NINE}, means AS (SELECT model, metric, round(avg(mean), 6) AS mean FROM nine GROUP BY ALL) SELECT model, {', '.join(f"coalesce(max(mean) FILTER (metric = '{m}'), 0.0) AS {m}" for m in TOKEN_METRICS)} FROM means GROUP BY model HAVING max(mean) > 0")
def summary_heat_map(spark, sf_dir):
    return rounded(summary.heat_map(numbered_stats(spark, sf_dir), TOKEN_METRICS), *TOKEN_METRICS)


@query(f"{_STATS_SQL} SELECT metric FROM (SELECT DISTINCT metric FROM stats) ORDER BY list_position({summary.PRIORITY}, metric) LIMIT 3")
def summary_top_metrics(spark, sf_dir):
    return summary.top_metrics(experiment_stats(spark, sf_dir), 3)


@query("SELECT DISTINCT 'events_' || event_type AS metric FROM events UNION SELECT DISTINCT lower(l_returnflag) FROM lineitem")
def summary_custom_metrics(spark, sf_dir):
    """Metrics of measurements in two tables beside the standard ones."""
    events = table(spark, sf_dir, "events").select(F.explode(F.array(F.concat(F.lit("events_"), "event_type"), F.lit("f1_score"))).alias("metric"))
    lines = table(spark, sf_dir, "lineitem").select(F.explode(F.array(F.lower("l_returnflag"), F.lit("bleu"))).alias("metric"))
    return summary.custom_metrics(events.union(lines))


@query(f"{_STATS_SQL} SELECT metric FROM (SELECT DISTINCT metric FROM stats) WHERE metric IN ('f1_score', 'jaccard')")
def summary_shared_metrics(spark, sf_dir):
    wanted = spark.createDataFrame([("f1_score",), ("jaccard",), ("bleu",)], "metric string")
    return summary.shared_metrics(experiment_stats(spark, sf_dir), wanted)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def summary_missing(spark, sf_dir):
    """Customers without an urgent order."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return summary.not_there(table(spark, sf_dir, "customer"), urgent, "c_custkey")


@query(f"{_STATS_SQL} SELECT setup, prompt, model, CAST(1 AS BIGINT) AS num_experiments, metric, round(mean, 4) AS mean FROM stats")
def summary_nested_round_trip(spark, sf_dir):
    means = summary.group_means(experiment_stats(spark, sf_dir))
    return summary.flattened(summary.nested(means))


@query("SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(5 AS INT) AS n_columns, 'doc_id,text,lang,source,n_chars' AS columns, CAST(count(*) FILTER (text IS NULL) AS BIGINT) AS null_texts FROM documents")
def dataset_profile(spark, sf_dir):
    return summary.profile(table(spark, sf_dir, "documents")).select("n_rows", "n_columns", F.array_join("columns", ",").alias("columns"), F.col("null_counts")["text"].alias("null_texts"))


@query("""SELECT setup, model, round(sum(processing_time), 8) AS total_time, round(avg(processing_time), 8) AS avg_time, round(min(processing_time), 8) AS min_time, round(max(processing_time), 8) AS max_time,
count(*) FILTER (success) AS n_success, count(*) FILTER (NOT success) AS n_error, count(*) FILTER (NOT success AND doc_id % 2 = 0) AS n_auth, round(count(*) FILTER (success) / count(*), 8) AS success_rate FROM (""" + _RESPONSES + ") GROUP BY setup, model")
def processing_statistics(spark, sf_dir):
    rows = responses(spark, sf_dir).withColumn("error", F.when(~F.col("success") & (F.col("doc_id") % 2 == 0), "Authentication failed").when(~F.col("success"), "timeout"))
    return rounded(evaluate.processing_stats(rows, ["setup", "model"]), "total_time", "avg_time", "min_time", "max_time", "success_rate", places=8)


# ---- paths, pruning, sampling, prompts -------------------------------------------------------------------


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS missing, coalesce(event_type, '') || '|' || coalesce(json_extract_string(props, '$.k'), '') AS pair FROM events")
def paths_json_column(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    schema = events.schema
    return events.select("event_id", paths.resolve(schema, "json:props.k").alias("k"), paths.resolve(schema, "json:props.none.deeper[3]").alias("missing"), F.array_join(paths.extract(schema, ["event_type", "json:props.k"]), "|").alias("pair"))


_JSON = """concat('{"c":[{"t":"', source, '"},{"t":null},{"t":"', lang, '"}],"n":{"m":[', CAST(n_chars AS VARCHAR), ',7]}}')"""


@query(f"""WITH j AS (SELECT doc_id, source, lang, n_chars, {_JSON} AS j FROM documents)
SELECT doc_id, source || ' ' || lang AS joined, json_extract_string(j, '$.c[2].t') AS third, json_extract_string(j, '$.n.m[0]') AS number, CAST(NULL AS VARCHAR) AS outside FROM j""")
def paths_nested_and_star(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("j", F.expr(_JSON.replace("VARCHAR", "STRING")))
    wanted = {"joined": "json:j.c[*].t", "third": "json:j.c[2].t", "number": "json:j.n.m[0]", "outside": "json:j.n.m[9]"}
    return docs.select("doc_id", *[paths.resolve(docs.schema, p).alias(n) for n, p in wanted.items()])


RULES = {"*": ["regex:^[A-Z !,.\\n]+$"], "lang": ["fr", "es"], "source": ["regex:src1[0-9]"]}


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(text, '^[A-Z !,.\n]+$') THEN 'text' WHEN lang IN ('fr', 'es') THEN 'lang' WHEN regexp_matches(source, 'src1[0-9]') THEN 'source' END AS reason FROM documents""")
def prune_reasons(spark, sf_dir):
    marked = prune.with_reason(table(spark, sf_dir, "documents"), RULES, ["text"], "lang")
    return marked.select("doc_id", F.when(F.col("prune_reason").startswith("any field"), "text").otherwise(F.regexp_extract("prune_reason", "^field '([a-z]+)'", 1)).alias("reason"))


@query("SELECT count(*) AS n_rows, count(*) FILTER (lang = 'fr') AS n_pruned, count(*) FILTER (lang <> 'fr') AS n_kept FROM documents")
def prune_accounting(spark, sf_dir):
    marked = prune.with_reason(table(spark, sf_dir, "documents"), {"lang": ["fr"]}, ["text"])
    return prune.accounting(marked, "doc_id").select("n_rows", "n_pruned", "n_kept")


def numbered_documents(spark, sf_dir):
    return sampling.with_row_index(table(spark, sf_dir, "documents"), "doc_id")


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_idx FROM documents")
def sampling_row_index(spark, sf_dir):
    return numbered_documents(spark, sf_dir).select("doc_id", "row_idx")


@query("SELECT doc_id, 'head' AS taken FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 7) UNION ALL SELECT doc_id, 'tail' FROM (SELECT * FROM documents ORDER BY doc_id DESC LIMIT 9)")
def sampling_head_and_tail(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return sampling.head(docs, 7, "doc_id").select("doc_id", F.lit("head").alias("taken")).union(sampling.tail(docs, 9, "doc_id").select("doc_id", F.lit("tail")))


_ROWS = "(SELECT count(*) FROM documents)"


@query(f"SELECT doc_id, row_idx, {permute.duck_sql('row_idx', _ROWS, sampling.SEED)} AS shuffled_idx FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_idx FROM documents)")
def sampling_permuted(spark, sf_dir):
    """Where a keyed permutation sends each row; the first of them are a sample."""
    docs = numbered_documents(spark, sf_dir)
    return docs.select("doc_id", "row_idx", permute.permuted("row_idx", docs.count(), sampling.SEED).alias("shuffled_idx"))


@query()
def sampling_exact(spark, sf_dir):
    return sampling.sample(numbered_documents(spark, sf_dir), 50).select("doc_id", "row_idx", "sample_idx")


@query()
def sampling_by_hash(spark, sf_dir):
    return sampling.hash_sample(table(spark, sf_dir, "documents"), "doc_id", 50).select("doc_id")


ZERO = prompts.Prompt("explain", prompts.ZERO_SHOT, "documents", "Explain {} from {}.\n")
FEW = prompts.Prompt("explain_shot", prompts.FEW_SHOT, "documents", "Explain {} from {}.\n", "Like {} from {}: {}\n\n")


@query("SELECT doc_id, sha256('Explain ' || text || ' from ' || source || '.' || chr(10)) AS prompt_sha, lang AS expected_output FROM documents")
def prompts_zero_shot(spark, sf_dir):
    made = prompts.render(table(spark, sf_dir, "documents"), ZERO, ["text", "source"], "lang")
    return made.select("doc_id", F.sha2("prompt", 256).alias("prompt_sha"), "expected_output")


@query("""SELECT d.doc_id, sha256('Like ' || e.text || ' from ' || e.source || ': ' || e.lang || chr(10) || chr(10) || 'Explain ' || d.text || ' from ' || d.source || '.' || chr(10)) AS prompt_sha
FROM documents d, (SELECT * FROM documents WHERE doc_id = 11) e""")
def prompts_few_shot(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    made = prompts.render(docs, FEW, ["text", "source"], "lang", docs.where("doc_id = 11"))
    return made.select("doc_id", F.sha2("prompt", 256).alias("prompt_sha"))


@query("""SELECT conv_id, turn, concat('### Human: ', text, chr(10), chr(10), '### Assistant: ', answer) AS text FROM
(SELECT conv_id, turn, role, text, lead(text) OVER w AS answer, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'""")
def prompts_chat_text(spark, sf_dir):
    from pyspark.sql import Window

    turns = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumn("answer", F.lead("text").over(turns)).withColumn("next_role", F.lead("role").over(turns))
    rows = rows.where("role = 'user' AND next_role = 'assistant'")
    return rows.select("conv_id", "turn", prompts.chat_format("text", F.col("text"), F.col("answer")).alias("text"))


SPLIT = TrainingRequest("documents", "explain", max_samples=500, train=0.85, validation=0.1)
_SPLIT_ROWS = "(SELECT count(*) FROM made)"


@query(f"""WITH kept AS (SELECT * FROM documents WHERE lang IS DISTINCT FROM 'fr' ORDER BY doc_id DESC LIMIT {SPLIT.max_samples}),
made AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_idx, 'Explain ' || text || ' from ' || source || '.' || chr(10) AS input, lang AS output FROM kept WHERE trim(coalesce(lang, '')) <> ''),
shuffled AS (SELECT *, {permute.duck_sql('row_idx', _SPLIT_ROWS, sampling.SEED)} AS shuffled_idx FROM made)
SELECT CASE WHEN shuffled_idx < CAST(floor(n * {SPLIT.train}) AS BIGINT) THEN 'train' WHEN shuffled_idx < CAST(floor(n * {SPLIT.train}) AS BIGINT) + greatest(1, CAST(floor(n * {SPLIT.validation}) AS BIGINT)) THEN 'validation' ELSE 'unused' END AS split,
       shuffled_idx, sha256(input) AS user_sha, output AS assistant FROM shuffled, (SELECT count(*) AS n FROM made)""")
def training_split(spark, sf_dir):
    made = examples(numbered_documents(spark, sf_dir), SPLIT, ZERO, ["text", "source"], "lang", {"lang": ["fr"]})
    out = formatted(split_examples(made, SPLIT, method="permuted"), "messages")
    said = lambda role: F.element_at(F.filter("messages", lambda m: m["role"] == role), 1)["content"]
    return out.select("split", "shuffled_idx", F.sha2(said("user"), 256).alias("user_sha"), said("assistant").alias("assistant"))


# ---- grids --------------------------------------------------------------------------------------------------


def dimensions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    setups = sampling.with_row_index(docs.select(F.col("lang").alias("setup")).distinct(), "setup", "ord")
    models = sampling.with_row_index(docs.select(F.col("source").alias("model")).distinct(), "model", "ord")
    asked = setups.select("setup").crossJoin(spark.createDataFrame([("a", "zero-shot"), ("b", "few-shot"), ("c", "zero-shot")], "p string, mode string"))
    listed = asked.select(F.concat_ws("_", "setup", "p").alias("prompt"), "setup", "mode")
    return models, setups, sampling.with_row_index(listed, "prompt", "ord")


_DIMENSIONS = """models AS (SELECT DISTINCT source AS model FROM documents), setups AS (SELECT DISTINCT lang AS setup FROM documents),
prompts AS (SELECT setup || '_' || p AS prompt, setup, mode FROM setups, (VALUES ('a', 'zero-shot'), ('b', 'few-shot'), ('c', 'zero-shot')) t(p, mode))"""
_NAME = "concat(setup, '__', model, '__', mode, '__', prompt, '__50__0p100')"


@query(f"WITH {_DIMENSIONS} SELECT model, setup, prompt, mode, {_NAME} AS experiment_name FROM models, prompts")
def grid_all(spark, sf_dir):
    models, setups, listed = dimensions(spark, sf_dir)
    return grid.plan(models, grid.triplets(listed, setups)).select("model", "setup", "prompt", "mode", "experiment_name")


@query(f"WITH {_DIMENSIONS} SELECT model, prompt, concat(setup, '__', model, '__', mode, CASE WHEN mode = 'few-shot' THEN '-7' ELSE '' END, '__', prompt, '__50__0p100') AS experiment_name FROM models, prompts")
def grid_few_shot_row(spark, sf_dir):
    models, setups, listed = dimensions(spark, sf_dir)
    return grid.plan(models, grid.triplets(listed, setups), few_shot_row=7).select("model", "prompt", "experiment_name")


#: Which task metrics the responses of each language get, in place of a configuration.
LANGUAGE_MODULES = {"en": "ecqa_choice", "de": "pubmedqa_free", "fr": "gmeg", "es": "ecare_explanation"}


def _duck_evaluation() -> str:
    """Core, n-gram and task metrics, similarity and a function, each row by row, then statistics over all."""
    d = DuckSql()
    parts = [f"SELECT doc_id, '{m}' AS metric, {m} AS value FROM ({_SCORES})" for m in TOKEN_METRICS]
    parts += [f"SELECT doc_id, '{m}', {m} FROM ngrams" for m in NGRAM_METRICS[:3]]
    parts.append("SELECT a.doc_id, 'semantic_similarity', coalesce(list_cosine_similarity(v.embedding::DOUBLE[], w.embedding::DOUBLE[]), 0.0) FROM rows a LEFT JOIN embeddings v ON v.vec_id = a.doc_id % 97 LEFT JOIN embeddings w ON w.vec_id = a.doc_id % 89")
    parts.append("SELECT doc_id, 'answer_length', CAST(length(response) AS DOUBLE) FROM rows")
    for setup, module in LANGUAGE_MODULES.items():
        source = _duck_stages(f"SELECT * FROM rows WHERE setup = '{setup}'", [*prepared_columns(d), *shared_columns(d, module)])
        scored = f"SELECT doc_id, {', '.join(f'{metric_sql(d, module, m)} AS {m}' for m in MODULES[module])} FROM ({source})"
        parts.append(f"SELECT doc_id, metric, value FROM (UNPIVOT ({scored}) ON {', '.join(MODULES[module])} INTO NAME metric VALUE value)")
    stats = ", ".join(f"round({f}(value), 6) AS {name}" for f, name in (("avg", "mean"), ("stddev_pop", "std"), ("min", "min"), ("max", "max"), ("median", "median")))
    return f"WITH rows AS MATERIALIZED ({_RESPONSES}), ngrams AS MATERIALIZED ({_duck_ngrams(15)}), long AS ({' UNION ALL '.join(parts)}) SELECT setup, prompt, model, metric, {stats} FROM long JOIN rows USING (doc_id) WHERE success GROUP BY setup, prompt, model, metric"


@query(_duck_evaluation())
def evaluate_end_to_end(spark, sf_dir):
    """Core, n-gram and task metrics, similarity of vectors and a registered function of all responses, to statistics of each experiment."""
    registry = MetricRegistry(LANGUAGE_MODULES)
    registry.register("answer_length", lambda r: len(r["response"]))
    vectors = table(spark, sf_dir, "embeddings").where("vec_id < 97").select("vec_id", "embedding")
    rows = spread_responses(spark, sf_dir)
    for name, every in (("given", 97), ("wanted", 89)):
        rows = rows.join(vectors.select(F.col("vec_id").alias(f"{name}_id"), F.col("embedding").alias(name)), F.col("doc_id") % every == F.col(f"{name}_id"), "left")
    found = evaluate.evaluate(rows, registry, ["setup", "prompt", "model"], "doc_id", vectors=("given", "wanted"))
    return rounded(found.where("metric <> 'rougeL_f'"), *evaluate.STATS)


@query(f"WITH {_DIMENSIONS} SELECT setup, prompt, mode FROM prompts WHERE setup IN ('de', 'en') AND mode = 'zero-shot'")
def grid_setups_and_mode(spark, sf_dir):
    _, setups, listed = dimensions(spark, sf_dir)
    return grid.triplets(listed, setups, wanted_setups=["en", "de"], mode="zero-shot").select("setup", "prompt", "mode")


@query(f"WITH {_DIMENSIONS} SELECT setup, prompt, mode, FALSE AS forced FROM prompts WHERE prompt = 'en_b' UNION ALL SELECT setup, prompt, mode, TRUE FROM prompts WHERE prompt IN ('en_b', 'fr_a')")
def grid_prompts_forced(spark, sf_dir):
    _, setups, listed = dimensions(spark, sf_dir)
    wanted = dict(wanted_setups=["en"], wanted_prompts=["fr_a", "en_b", "en_b"], mode="few-shot")
    found = [grid.triplets(listed, setups, **wanted, force=f).select("setup", "prompt", "mode", F.lit(f).alias("forced")) for f in (False, True)]
    return found[0].union(found[1])


@query(f"WITH {_DIMENSIONS}, plan AS (SELECT *, {_NAME} AS experiment_name FROM models, prompts) SELECT experiment_name FROM plan WHERE setup <> 'en' OR mode <> 'zero-shot'")
def grid_missing(spark, sf_dir):
    models, setups, listed = dimensions(spark, sf_dir)
    planned = grid.plan(models, grid.triplets(listed, setups))
    return grid.missing(planned, planned.where("setup = 'en' AND mode = 'zero-shot'")).select("experiment_name")


@query(f"WITH {_DIMENSIONS}, plan AS (SELECT * FROM models, prompts) SELECT 'mode' AS dimension, mode AS value, count(*) AS n FROM plan GROUP BY mode UNION ALL SELECT 'setup', setup, count(*) FROM plan GROUP BY setup UNION ALL SELECT 'model', model, count(*) FROM plan GROUP BY model")
def grid_histograms(spark, sf_dir):
    models, setups, listed = dimensions(spark, sf_dir)
    return grid.histograms(grid.plan(models, grid.triplets(listed, setups)))


@query(f"WITH {_DIMENSIONS} SELECT model, setup, array_to_string(list_sort(list({_NAME})), ';') AS experiments FROM models, prompts GROUP BY model, setup")
def grid_by_model(spark, sf_dir):
    models, setups, listed = dimensions(spark, sf_dir)
    return grid.grouped_for_models(grid.plan(models, grid.triplets(listed, setups))).withColumn("experiments", F.array_join(F.array_sort("experiments"), ";"))


# ---- sources, sinks, hooks, streams ------------------------------------------------------------------------


@query("SELECT s_suppkey, s_name FROM supplier")
def source_csv_round_trip(spark, sf_dir):
    path = new_path(spark, "csv")
    sinks.write_csv(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), path)
    return readers.read_csv(spark, path, exact=True).select(F.col("s_suppkey").cast("long"), "s_name")


@query("SELECT doc_id, lang, sha256(text) AS text_sha FROM documents")
def source_csv_parallel(spark, sf_dir):
    """Whole texts with their newlines and quotes, written as CSV files, one for each split of the table, and read by a task for each of their splits."""
    path = new_path(spark, "csv")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    sinks.write_csv(docs, path)
    return readers.read_csv(spark, path, docs.schema, exact=True).select("doc_id", "lang", F.sha2("text", 256).alias("text_sha"))


@query("SELECT conv_id, turn, role, text FROM conversations")
def source_jsonl_round_trip(spark, sf_dir):
    path = new_path(spark, "jsonl")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows.write.json(path)
    return readers.read_jsonl(spark, path, rows.schema)


@query("SELECT setup || '__' || model AS experiment_name, doc_id, sha256(expected_output) AS expected_sha, success FROM (" + _RESPONSES + ")")
def sink_documents_round_trip(spark, sf_dir):
    rows = responses(spark, sf_dir).select(F.concat_ws("__", "setup", "model").alias("experiment_name"), "setup", F.col("prompt").alias("prompt_name"), "model", F.col("doc_id").alias("row_idx"), F.col("doc_id").cast("string").alias("prompt"), "response", "expected_output", "question_values", "processing_time", "success", F.lit(None).cast("string").alias("error"))
    path = new_path(spark, "documents")
    sinks.write_documents(sinks.inference_documents(rows.withColumn("prompt_name", F.lit("q"))), path)
    again = evaluate.paired(spark.read.schema(readers.INFERENCE).json(path))
    return again.select("experiment_name", F.col("prompt").cast("long").alias("doc_id"), F.sha2("expected_output", 256).alias("expected_sha"), "success")


def _reversed(model: str):
    """The stub of a model."""
    return lambda prompt: f"{model}: {prompt[:20][::-1]}"


@query("SELECT doc_id, source || ': ' || reverse(left('Explain ' || source, 20)) AS response, TRUE AS success FROM documents")
def hook_generate(spark, sf_dir):
    asked = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("model"), F.concat(F.lit("Explain "), "source").alias("prompt"))
    return inference.generate(asked, _reversed).select("doc_id", "response", "success")


@query("SELECT date_trunc('hour', ts) AS window_start, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS n_success, round(count(*) FILTER (event_type = 'purchase') / count(*), 6) AS success_rate FROM events GROUP BY 1")
def stream_success_rate(spark, sf_dir):
    out = live.success_rate(table(spark, sf_dir, "events"), "ts", F.col("event_type") == "purchase")
    return rounded(out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")), "success_rate")


# ---- the same aggregations over larger tables ---------------------------------------------------------------


@query("SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS std, min(l_extendedprice) AS min, max(l_extendedprice) AS max, median(l_extendedprice) AS median FROM lineitem GROUP BY ALL")
def large_five_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_extendedprice").alias("value"))
    return rounded(evaluate.five_stats(rows, ["l_returnflag", "l_linestatus"]), "mean", "std", places=4)


@query("SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS std, min(l_extendedprice) AS min, max(l_extendedprice) AS max, median(l_extendedprice) AS median FROM lineitem GROUP BY ALL")
def large_merged_stats(spark, sf_dir):
    """The same from states of five batches, which are stored and merged, with medians from the merged sketch's bracket."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_extendedprice").alias("value"), (F.col("l_suppkey") % 5).alias("batch"))
    by, path = ["l_returnflag", "l_linestatus"], new_path(spark, "states")
    for batch in range(5):
        states.append(rows.where(F.col("batch") == batch), by, path, str(batch))
    return rounded(states.five_stats(rows, by, of=states.current(spark, path, by)), "mean", "std", places=4)


@query(f"{_STATS_SQL} SELECT setup, prompt, model, metric, {_rounded_sql(evaluate.STATS)} FROM stats")
def core_merged_stats(spark, sf_dir):
    """Statistics of experiments whose responses came in two batches."""
    by, keys = ["setup", "prompt", "model", "metric"], ["doc_id", "setup", "prompt", "model"]
    scored = token_scores(responses(spark, sf_dir), keys).where("generation_failed = 0").drop("generation_failed")
    long = written(evaluate.long_form(scored, keys, TOKEN_METRICS), "scores")
    path = new_path(spark, "states")
    for batch, part in enumerate((long.where("doc_id % 2 = 0"), long.where("doc_id % 2 = 1"))):
        states.append(part, by, path, str(batch))
    return rounded(states.five_stats(long, by, of=states.current(spark, path, by)), *evaluate.STATS)


@query("""SELECT metric, experiment_name, mean, rank FROM (SELECT l_returnflag AS metric, CAST(l_suppkey AS VARCHAR) AS experiment_name, round(avg(l_quantity), 6) AS mean,
row_number() OVER (PARTITION BY l_returnflag ORDER BY round(avg(l_quantity), 6) DESC, CAST(l_suppkey AS VARCHAR)) AS rank FROM lineitem GROUP BY l_returnflag, l_suppkey)""")
def large_ranked(spark, sf_dir):
    means = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("metric"), F.col("l_suppkey").cast("string").alias("experiment_name")).agg(F.round(F.avg("l_quantity"), 6).alias("mean"))
    return summary.ranked(means).select("metric", "experiment_name", "mean", F.col("rank").cast("long").alias("rank"))


@query("SELECT o_orderpriority AS model, round(coalesce(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 0), 4) AS F, round(coalesce(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 0), 4) AS O FROM orders GROUP BY 1")
def large_heat_map(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("metric"), F.col("o_totalprice").alias("mean"))
    return rounded(summary.heat_map(rows, ["F", "O"]), "F", "O", places=4)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every response, then five statistics per experiment and metric."""
    return core_experiment_stats(spark, sf_dir)
