"""Queries over run logs. The events table plays the log: event types are entry types, users are runs and questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.catalog import Tables, query
from quillon.functions import text as T
from quillon.operators import runlog as R

KINDS = {"view": "proof", "click": "correctness", "purchase": "answer", "signup": "document_indexing", "error": "llm_call"}
LOG = """log as (select 'run' || (user_id % 5) as run_id, ts as timestamp, case event_type when 'view' then 'proof' when 'click' then 'correctness' when 'purchase' then 'answer' when 'signup' then 'document_indexing' else 'llm_call' end as entry_type,
cast(user_id as varchar) as identifier, case event_type when 'view' then cast(k % 30 - 1 as varchar) when 'click' then case k % 3 when 0 then 'correct' when 1 then 'wrong' else 'formatting_error' end else cast(value as varchar) end as value, event_id as row_no, k, value as number
from (select *, cast(json_extract(props, '$.k') as int) as k from events))"""


def log_of(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col("event_type"))
    verdict = F.when(k % 3 == 0, "correct").when(k % 3 == 1, "wrong").otherwise("formatting_error")
    value = F.when(F.col("event_type") == "view", (k % 30 - 1).cast("string")).when(F.col("event_type") == "click", verdict).otherwise(F.col("value").cast("string"))
    return t.events.select(F.concat(F.lit("run"), F.col("user_id") % 5).alias("run_id"), F.col("ts").alias("timestamp"), kind.alias("entry_type"), F.col("user_id").cast("string").alias("identifier"), value.alias("value"), F.col("event_id").alias("row_no"), k.alias("k"), F.col("value").alias("number"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, kind in df.dtypes if kind == "double"})


@query(f"""with {LOG}, q as (select run_id, identifier, avg(case when cast(value as int) between 0 and 0 then 1.0 else 0 end) as a, avg(case when cast(value as int) between 0 and 4 then 1.0 else 0 end) as b, avg(case when cast(value as int) between 0 and 9 then 1.0 else 0 end) as c from log where entry_type = 'proof' group by 1, 2)
select run_id, round(avg(a) * 100, 6) as recall_1, round(avg(b) * 100, 6) as recall_5, round(avg(c) * 100, 6) as recall_10 from q group by run_id""")
def recall_at_k(t: Tables) -> DataFrame:
    return rounded(R.recall_at_k(log_of(t), [1, 5, 10]))


@query(f"""with {LOG}, q as (select run_id, identifier, avg(case when try_cast(value as double) >= 0 and try_cast(value as double) < 5 then 1.0 else 0 end) as b from log where entry_type = 'proof' and run_id <> 'run1' group by 1, 2)
select r.run_id, m.r as recall_5 from (select distinct run_id from log) r left join (select run_id, round(avg(b) * 100, 6) as r from q group by run_id) m on r.run_id = m.run_id""")
def ablation_recall(t: Tables) -> DataFrame:
    """As recall, but runs without usable rows have none."""
    log = log_of(t)
    broken = log.withColumn("value", F.when((F.col("run_id") == "run1") & (F.col("entry_type") == "proof"), "n/a").otherwise(F.col("value")))
    return rounded(R.recall_at_k(broken, [5], empty=None))


@query(f"with {LOG} select run_id, round(avg(case when value = 'correct' then 1.0 else 0 end) * 100, 6) as accuracy from log where entry_type = 'correctness' group by run_id")
def qa_accuracy(t: Tables) -> DataFrame:
    return rounded(R.accuracy(log_of(t)))


@query(f"""with {LOG}, g as (select run_id, identifier, max(case when cast(value as int) between 0 and 4 then 1 else 0 end) as grounded from log where entry_type = 'proof' group by 1, 2),
v as (select run_id, identifier, arg_max(value, (timestamp, row_no)) as verdict from log where entry_type = 'correctness' group by 1, 2),
m as (select g.*, case when verdict = 'correct' then 1.0 else 0 end as ok from g left join v on g.run_id = v.run_id and g.identifier = v.identifier)
select run_id, round(coalesce(avg(case when grounded = 1 then ok end) * 100, 0), 6) as faithfulness, round(coalesce(avg(case when grounded = 0 then ok end) * 100, 0), 6) as unsupported from m group by run_id""")
def faithfulness(t: Tables) -> DataFrame:
    return rounded(R.faithfulness(log_of(t), 5))


@query(f"with {LOG} select run_id, round(avg(number), 6) as mean, round(median(number), 6) as median from log where entry_type = 'answer' group by run_id")
def rouge_stats(t: Tables) -> DataFrame:
    return rounded(R.value_stats(log_of(t), "answer"))


@query(f"""with {LOG} select run_id, count(distinct case when entry_type = 'document_indexing' then identifier end) as num_documents, count(distinct case when entry_type = 'answer' then identifier end) as num_questions,
cast(floor(sum(case when entry_type = 'llm_call' then number end)) as bigint) as num_chunks from log group by run_id""")
def run_counts(t: Tables) -> DataFrame:
    return R.counts(log_of(t), "document_indexing", "answer", "llm_call")


@query(f"""with {LOG} select run_id, round(avg(case when identifier <> '8' then number end), 6) as indexing_avg, round(coalesce(max(case when identifier = '8' then number end), sum(number)), 6) as indexing_total from log where entry_type = 'document_indexing' group by run_id""")
def indexing_times(t: Tables) -> DataFrame:
    return rounded(R.indexing_times(log_of(t), "document_indexing", "8"))


@query(f"with {LOG}, q as (select run_id, identifier, sum(number) as s from log where entry_type = 'answer' group by 1, 2) select run_id, round(avg(s), 6) as time_avg from q group by run_id")
def times_per_question(t: Tables) -> DataFrame:
    return rounded(R.per_question(log_of(t), "answer"))


@query(f"""with {LOG}, c as (select run_id, identifier, count(*) as n, sum(number) as s from log where entry_type = 'llm_call' and (run_id, identifier) in (select run_id, identifier from log where entry_type = 'answer' and k < 20) group by 1, 2)
select run_id, round(avg(n), 6) as calls, round(sum(s) / sum(n), 6) as call_avg from c group by run_id""")
def llm_calls(t: Tables) -> DataFrame:
    log = log_of(t).where("entry_type <> 'answer' or k < 20")
    return rounded(R.calls_per_question(log, "llm_call", "answer"))


@query(f"""with {LOG}, s as (select run_id, cast(epoch(date_trunc('second', max(timestamp))) - epoch(date_trunc('second', min(timestamp))) as bigint) as s from log group by run_id)
select run_id, s as seconds, (s // 3600) || ' h ' || (s % 3600 // 60) || ' m ' || (s % 60) || ' s' as execution_time from s""")
def execution_time(t: Tables) -> DataFrame:
    return R.execution_time(log_of(t))


@query(f"""with {LOG}, s as (select run_id, sum(case when entry_type in ('llm_call', 'answer') then number else 0 end) as i, sum(case when entry_type = 'document_indexing' then number else 0 end) as o from log group by run_id)
select run_id, round(i, 6) as tokens_in, round(o, 6) as tokens_out, round(case when run_id = 'run0' then 0.3 else i / 1e6 * 0.25 + o / 1e6 * 0.5 end, 8) as cost from s""")
def run_cost(t: Tables) -> DataFrame:
    totals = R.token_totals(log_of(t), ["llm_call", "answer"], ["document_indexing"])
    actual = F.when(F.col("run_id") == "run0", 0.3).otherwise(0.0)
    return totals.select("run_id", F.round("tokens_in", 6).alias("tokens_in"), F.round("tokens_out", 6).alias("tokens_out"), F.round(R.cost(actual, F.col("tokens_in"), F.col("tokens_out")), 8).alias("cost"))


@query(f"""with {LOG} select run_id, round(coalesce(avg(case when entry_type = 'answer' then number end), 0), 6) as answer_avg, round(coalesce(sum(case when entry_type = 'document_indexing' then number end), 0), 6) as indexing_sum,
cast(count(case when entry_type = 'llm_call' then 1 end) as double) as calls from log group by run_id""")
def efficiency_table(t: Tables) -> DataFrame:
    return rounded(R.summary(log_of(t), {"answer_avg": ("answer", "avg"), "indexing_sum": ("document_indexing", "sum"), "calls": ("llm_call", "count")}))


@query(f"""with {LOG}, q as (select run_id, identifier, avg(case when cast(value as int) between 0 and 4 then 1.0 else 0 end) as a, avg(case when cast(value as int) between 0 and 24 then 1.0 else 0 end) as b from log where entry_type = 'proof' group by 1, 2)
select r.run_id, round(avg(a) * 100, 6) as recall_5, round(avg(b) * 100, 6) as recall_25, any_value(acc) as accuracy, any_value(m) as rouge from q r join (select run_id, round(avg(case when entry_type = 'correctness' then case when value = 'correct' then 1.0 else 0 end end) * 100, 6) as acc, round(avg(case when entry_type = 'answer' then number end), 6) as m from log group by run_id) x on x.run_id = r.run_id group by r.run_id""")
def performance_table(t: Tables) -> DataFrame:
    log = log_of(t)
    scores = R.value_stats(log, "answer").select("run_id", F.col("mean").alias("rouge"))
    return rounded(R.recall_at_k(log, [5, 25]).join(R.accuracy(log), "run_id", "left").join(scores, "run_id", "left"))


@query(f"""with {LOG}, c as (select run_id, entry_type, avg(number) as v from log group by 1, 2) select r.run_id, round(coalesce(max(case when entry_type = 'answer' then v end), 0), 6) as answer, round(coalesce(max(case when entry_type = 'proof' then v end), 0), 6) as proof, cast(0 as double) as absent
from (select unnest(['run0', 'run1', 'run2', 'run9']) as run_id) r left join c on c.run_id = r.run_id group by r.run_id""")
def approach_matrix(t: Tables) -> DataFrame:
    cells = log_of(t).groupBy("run_id", "entry_type").agg(F.avg("number").alias("v"))
    return rounded(R.matrix(cells, "run_id", "entry_type", "v", ["run0", "run1", "run2", "run9"], ["answer", "proof", "absent"]))


@query(f"with {LOG}, p as (select entry_type, run_id, avg(number) as v from log group by 1, 2) select entry_type, round(max(case when run_id = 'run0' then v end), 6) as baseline, round(max(case when run_id = 'run1' then v end), 6) as run1, round(max(case when run_id = 'run2' then v end), 6) as run2 from p group by entry_type")
def ablation_table(t: Tables) -> DataFrame:
    wide = log_of(t).groupBy("entry_type").pivot("run_id", ["run0", "run1", "run2"]).agg(F.avg("number"))
    return rounded(wide.withColumnRenamed("run0", "baseline"))


@query(f"""with {LOG} select run_id, count(*) as documents, min(number) as least, max(number) as most, round(avg(number), 6) as mean, round(median(number), 6) as median, round(stddev_pop(number), 6) as deviation, round(sum(number), 6) as total_ms, round(sum(number) / 1000, 6) as total_s, round(sum(number) / 60000, 6) as total_min
from log where entry_type = 'document_indexing' group by run_id""")
def indexing_statistics(t: Tables) -> DataFrame:
    return rounded(R.time_statistics(log_of(t), "document_indexing"))


@query(f"with {LOG} select run_id, row_no, cast(row_number() over w as int) as step, round(sum(number) over (w rows unbounded preceding), 4) as running from log where entry_type = 'document_indexing' window w as (partition by run_id order by timestamp, row_no)")
def cumulative_time(t: Tables) -> DataFrame:
    return rounded(R.cumulative(log_of(t), "document_indexing"), 4)


MARK = "(entry_type = 'document_indexing' and k < 10)"


@query(f"""with {LOG}, s as (select *, coalesce(sum(case when {MARK} then 1 else 0 end) over (partition by run_id order by row_no rows between unbounded preceding and 1 preceding), 0) as step from log),
g as (select run_id, step, sum(case when entry_type = 'llm_call' then number else 0 end) as total, count(case when entry_type = 'llm_call' then 1 end) as calls, avg(case when entry_type = 'llm_call' then number end) as mean, max(case when {MARK} then number end) as actual from s group by 1, 2)
select run_id, cast(step as bigint) as step, round(total, 8) as total, calls, round(mean, 8) as mean, round(actual, 8) as actual, round(actual - total + avg(total) over (partition by run_id), 8) as adjusted from g""")
def step_totals(t: Tables) -> DataFrame:
    return rounded(R.step_totals(log_of(t), F.expr(MARK), "llm_call"), 8)


@query(f"""with {LOG}, b as (select *, sum(case when k = 0 then 1 else 0 end) over (partition by run_id order by row_no) as block from log)
select run_id, cast(block as bigint) as block, entry_type as key, round(avg(number), 9) as average from b group by all""")
def block_timings(t: Tables) -> DataFrame:
    records = R.blocks(log_of(t), F.col("k") == 0).withColumn("timings", F.create_map("entry_type", "number"))
    return rounded(R.timing_averages(records, "timings", ["run_id", "block"]), 9)


@query(f"with {LOG} select entry_type as key, round(avg(number), 6) as average from log group by 1")
def timing_averages(t: Tables) -> DataFrame:
    return rounded(R.timing_averages(log_of(t).withColumn("timings", F.create_map("entry_type", "number")), "timings"))


TOP5 = "c as (select *, row_number() over (partition by user_id order by value desc, event_id) as r, cast(json_extract(props, '$.k') as double) as k from events)"


@query(f"with {TOP5} select 'value' as feature, round(sum(value * 2.0), 4) as total from c where r <= 5 union all select 'k', round(sum(k * 0.5), 4) from c where r <= 5")
def feature_contributions(t: Tables) -> DataFrame:
    return rounded(R.contributions(_top5(t), ["value", "k"], {"value": 2.0, "k": 0.5}), 4)


@query(f"with {TOP5} select 'value' as feature, round(avg(value * 2.0 / (value * 2.0 + k * 0.5)), 6) as share from c where r <= 5 and value * 2.0 + k * 0.5 > 0 union all select 'k', round(avg(k * 0.5 / (value * 2.0 + k * 0.5)), 6) from c where r <= 5 and value * 2.0 + k * 0.5 > 0")
def signal_shares(t: Tables) -> DataFrame:
    return rounded(R.signal_shares(_top5(t), ["value", "k"], {"value": 2.0, "k": 0.5}))


def _top5(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return t.events.withColumn("r", F.row_number().over(w)).where("r <= 5").withColumn("k", F.get_json_object("props", "$.k").cast("double"))


@query(f"with {LOG} select distinct entry_type, cast(case entry_type when 'answer' then 1 when 'proof' then 2 else 3 end as int) as place from log")
def display_order(t: Tables) -> DataFrame:
    return log_of(t).select("entry_type").distinct().withColumn("place", R.display_order(F.col("entry_type"), ["answer", "proof"]).cast("int"))


@query(f"with {LOG} select run_id, identifier, number from log where entry_type = 'answer' and (run_id, identifier) in (select run_id, identifier from log where entry_type = 'proof' and k < 5)")
def log_values(t: Tables) -> DataFrame:
    log = log_of(t)
    return R.values(log, "answer", log.where("entry_type = 'proof' and k < 5"))


@query("select p_partkey, string_split(p_name, ' ')[1] as dataset, string_split(p_name, ' ')[2] as version, array_to_string(string_split(p_name, ' ')[3:], '-') as config from part where string_split(p_name, ' ')[1] <> 'x'")
def config_names(t: Tables) -> DataFrame:
    """Names like dataset-version-config taken apart; what follows the second mark is joined again."""
    parts = F.split("p_name", " ")
    return t.part.select("p_partkey", parts[0].alias("dataset"), F.try_element_at(parts, F.lit(2)).alias("version"), F.array_join(F.slice(parts, 3, 1000), "-").alias("config")).where("dataset <> 'x'")


@query("""with r as (select date_trunc('day', ts) as d, sum(value) as retrieval from events where event_type = 'view' group by 1), g as (select date_trunc('day', ts) as d, sum(value) as generation from events where event_type = 'error' and value > 100 group by 1)
select cast(r.d as date) as step, round(retrieval, 4) as retrieval, round(coalesce(generation, 0), 4) as generation from r left join g on r.d = g.d""")
def scaling_totals(t: Tables) -> DataFrame:
    day = F.to_date("ts").alias("step")
    r = t.events.where("event_type = 'view'").groupBy(day).agg(F.sum("value").alias("retrieval"))
    g = t.events.where("event_type = 'error' and value > 100").groupBy(day).agg(F.sum("value").alias("generation"))
    return rounded(r.join(g, "step", "left").fillna({"generation": 0.0}), 4)
