"""Queries over DataFrame operators: sequential state, and forms of declared operators that are linear in a document."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from lineflow.functions.dialect import Duck, Spark
from lineflow.config import Config
from lineflow.operators import chain, contain, generic, learn, measure, sequential, user
from lineflow.plans import views
from lineflow.plans.catalog import NATIVE_ORACLES, native
from lineflow.session import line_counter, shared_path, table
from lineflow.sources import live, readers, sinks
from lineflow.streaming import filter as stream

native("dt04_rate_limit")(lambda spark, sf_dir: sequential.rate_limit(spark.sql(f"select tool, us, id from {views.requests(Spark(sf_dir))} v"), 1, 2))
native("a20_lru")(lambda spark, sf_dir: sequential.lru_hits(spark.sql(f"select tool, us, id, raw_key as key from {views.requests(Spark(sf_dir))} v"), 4))

_NUMBERED = f"(select tool, us, id, raw_key as key, row_number() over (partition by tool order by us, id) as i from {views.requests(Duck())} v)"
# A key is still cached if fewer than the capacity's keys were asked for since it was.
NATIVE_ORACLES["a20_lru"] = f"""
with r as {_NUMBERED},
p as (select *, max(i) over (partition by tool, key order by i rows between unbounded preceding and 1 preceding) as prev from r),
n as (select p.tool, p.i, count(distinct r.key) as between_keys from p join r on r.tool = p.tool and r.i > p.prev and r.i < p.i group by all)
select p.tool, p.us, p.id, p.key, prev is not null and coalesce(between_keys, 0) < 4 as hit from p left join n on p.tool = n.tool and p.i = n.i"""
# What is left in the bucket follows from what the request before left.
NATIVE_ORACLES["dt04_rate_limit"] = f"""
with recursive r as {_NUMBERED},
b as (select tool, i, us, id, true as allowed, 1.0::double as rest from r where i = 1 union all
    select tool, i, us, id, x >= 1, x - case when x >= 1 then 1 else 0 end from (select r.*, least(2.0::double, b.rest + (r.us - b.us)::double / 1e6 * 1 / 60) as x from r join b on r.tool = b.tool and r.i = b.i + 1) s)
select tool, us, id, allowed from b"""


@native("r01_stream_filter")
def stream_filter(spark, sf_dir):
    lines = spark.sql(f"select doc as doc_id, pos as seq, line, pos % 10 = 3 as is_stderr from {views.log_lines(Spark(sf_dir))} v")
    return stream.filter_stream(lines).withColumn("out", F.col("out"))


# The declarations of the same names stay their oracles.
def _lines_and_text(spark, sf_dir, lines, removed):
    """Lines (doc, pos, line) and their texts after some lines were removed."""
    d = Spark(sf_dir)
    return spark.sql(f"select doc, pos, line from {lines(d)} v"), spark.sql(f"select doc, text from {generic.assemble(d, generic.remove_by_rules(d, lines(d) + ' v', removed) + ' r')} t")


@native("f14_keep_rules")
def keep_rules(spark, sf_dir):
    lines, clean = _lines_and_text(spark, sf_dir, views.log_lines, ["^ERROR", "panic"])
    return contain.kept_by_rules(lines.where(Spark().any_of(["ERROR", "panic", "TODO"], "line")), clean)


@native("a11_quality")
def quality(spark, sf_dir):
    d = Spark(sf_dir, line_counter(spark, sf_dir))
    lines = d.spread(views.command_lines(d, "test"), "orders")
    clean = generic.chain(d, generic.assemble(d, lines + " v", sub=False) + " s")
    return measure.quality_of(spark.sql(f"select * from {lines} v"), spark.sql(f"select * from {clean} c"))


@native("a13_bench_quality")
def bench_quality(spark, sf_dir):
    return measure.quality_of(*_lines_and_text(spark, sf_dir, views.log_lines, ["^TODO", "panic"]), bench=True)


@native("s02_capped_capture")
def capped_capture(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id as doc", "coalesce(text, '') as text")
    return readers.capped(docs)


# Beyond the cap this oracle cuts characters, the reader bytes.
NATIVE_ORACLES["s02_capped_capture"] = f"""select doc_id as doc, case when octet_length(encode(coalesce(text, ''))) > {readers.CAPTURE_CAP}
    then left(text, {readers.CAPTURE_CAP}) || chr(10) || '{readers.CAPTURE_NOTICE.strip()}' else coalesce(text, '') end as text from documents"""


def _written(spark, sf_dir):
    """A measurement log of the events as JSON lines, with a key that no column has and, for every 50th event, a broken line."""
    path = shared_path(spark, "log")
    rows = spark.sql(f"select *, concat('2024-01-', lpad(cast(1 + id % 28 as string), 2, '0'), 'T00:00:', lpad(cast(id % 60 as string), 2, '0'), 'Z') as ts from {views.measurements(Spark(sf_dir))} m")
    entry = F.to_json(F.struct("ts", "session", "cmd_type", "raw_bytes", "clean_bytes", "raw_tokens", F.when(F.col("id") % 3 == 0, F.col("rerequest")).alias("rerequest"), F.col("id").alias("ticket")))
    broken = F.when(F.col("id") % 100 == 0, F.lit("[1, 2]")).otherwise(F.concat(F.lit('{"ts": "'), F.col("ts")))
    lines = rows.select(F.explode(F.array_compact(F.array(entry, F.when(F.col("id") % 50 == 0, broken)))).alias("value"))
    lines.write.text(path)
    return path


_LOG = f"(select *, concat('2024-01-', lpad(cast(1 + id % 28 as varchar), 2, '0'), 'T00:00:', lpad(cast(id % 60 as varchar), 2, '0'), 'Z') as ts from {views.measurements(Duck())} m)"


@native("s09_log")
def log(spark, sf_dir):
    rows = readers.measurements(spark, _written(spark, sf_dir), raw=True)
    return rows.select(F.expr("variant_get(raw, '$.ticket', 'bigint')").alias("id"), "ts", "session", "cmd_type", "raw_bytes", "clean_bytes", "raw_tokens", "rerequest", "rerequest_type")


NATIVE_ORACLES["s09_log"] = f"select id, ts, session, cmd_type, raw_bytes, clean_bytes, raw_tokens, id % 3 = 0 and rerequest as rerequest, '' as rerequest_type from {_LOG} l"


@native("s09_log_health")
def log_health(spark, sf_dir):
    return readers.log_health(spark, _written(spark, sf_dir))


NATIVE_ORACLES["s09_log_health"] = f"select count(*) as entries, count(*) filter (id % 50 = 0) as malformed from {_LOG} l"


@native("s10_since")
def since(spark, sf_dir):
    return readers.measurements(spark, _written(spark, sf_dir), "2024-01-15").groupBy("cmd_type").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"))


NATIVE_ORACLES["s10_since"] = f"select cmd_type, count(*) as n, min(ts) as first from {_LOG} l where ts >= '2024-01-15' group by cmd_type"


@native("s11_observations")
def observations(spark, sf_dir):
    path = shared_path(spark, "observations")
    rows = table(spark, sf_dir, "events").select(F.lit("2024").alias("ts"), F.col("event_type").alias("cmd"), F.concat(F.lit("n"), (F.col("event_id") % 17).cast("string")).alias("norm"), (F.col("event_id") % 6).cast("int").alias("level"), F.lit("s").alias("session"), F.lit(True).alias("extra"))
    sinks.append_log(rows, path)
    return readers.observations(spark, path).groupBy("cmd", "norm", "level").agg(F.count(F.lit(1)).alias("n"))


NATIVE_ORACLES["s11_observations"] = "select event_type as cmd, 'n' || (event_id % 17) as norm, (event_id % 6)::int as level, count(*) as n from events group by all"


def _observed(d):
    """Observations of the documents' lines: sources are sessions, languages commands."""
    docs = f"(select doc_id as doc, coalesce(text, '') as text, coalesce(source, '') as session, coalesce(lang, '') as cmd from {d.table('documents')}) v"
    return learn.observe(d, f"(select line, session, cmd, doc as ts from {generic.split_lines(d, docs, 'session, cmd')} l) v")


_LEARN = dict(sessions=2, least=0.0005, most=1.0, noise=0.0)


@native("a08_learn_stored")
def learn_stored(spark, sf_dir):
    """The observations are stored once, as the tools do; the sketch and the counts read the store."""
    path = shared_path(spark, "observed")
    spark.sql(f"select * from {_observed(Spark(sf_dir))} o").write.parquet(path)
    return spark.sql(f"select * from {learn.analyse_frequent(Spark(), f'parquet.`{path}`', **_LEARN)} q")


NATIVE_ORACLES["a08_learn_stored"] = f"select * from {learn.analyse(Duck(), _observed(Duck()) + ' o', **_LEARN)} q"


def _report(spark, sf_dir, columns, outer):
    """One JSON report, as the tools save it, of a row per event type."""
    path = shared_path(spark, "report")
    rows = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("s"))
    rows.select(F.struct(*columns).alias("r")).groupBy().agg(F.collect_list("r").alias("rs")).select(F.to_json(outer(F.col("rs")))).write.text(path)
    return path


@native("s12_bench_report")
def bench_report(spark, sf_dir):
    columns = [F.col("event_type").alias("name"), F.col("s").alias("raw_bytes"), F.col("n").alias("clean_bytes"), F.round(F.col("n") / F.col("s") * 100, 6).alias("reduction"), F.col("n").alias("lines_raw")]
    return readers.bench_results(spark, _report(spark, sf_dir, columns, lambda rs: F.struct(F.lit(1).alias("total_raw"), rs.alias("results"))))


NATIVE_ORACLES["s12_bench_report"] = "select event_type as name, sum(event_id)::bigint as raw_bytes, count(*) as clean_bytes, round(count(*)::double / sum(event_id)::double * 100, 6) as reduction, null::bigint as duration_us, count(*) as lines_raw, null::bigint as lines_clean from events group by event_type"


@native("s13_step_snapshot")
def step_snapshot(spark, sf_dir):
    columns = [F.col("event_type").alias("filter"), F.col("s").alias("bytes_before"), F.col("n").alias("bytes_after"), F.lit(1.5).alias("reduction_pct"), F.col("n").alias("invocations")]
    return readers.step_snapshot(spark, _report(spark, sf_dir, columns, lambda rs: F.struct(F.lit("now").alias("generated_at"), rs.alias("filters"))))


NATIVE_ORACLES["s13_step_snapshot"] = "select 'now' as generated_at, event_type as filter, sum(event_id)::bigint as bytes_before, count(*) as bytes_after, 1.5::double as reduction_pct, null::bigint as duration_us, count(*) as invocations from events group by event_type"


#: The assembled chain of a type, up to its summary: what the settings and the registry put together, run by Chain.apply,
#: held against the same steps as one declaration.
def _chain(kind):
    built = chain.build(Config(), kind)
    return chain.Chain(tuple(s for s in built.steps if s.frame is None and s.name != "truncate"))


def _assembled_chain(kind, lines):
    name = f"u01_chain_{kind}"
    texts = lambda d: f"(select doc, text from {generic.assemble(d, d.spread(lines(d), 'orders') + ' v', sub=False)} t)"
    native(name)(lambda spark, sf_dir: _chain(kind).apply(spark.sql(f"select * from {texts(Spark(sf_dir, line_counter(spark, sf_dir)))} q")))
    NATIVE_ORACLES[name] = f"select doc, coalesce(text, '') as text from {chain.declared(Duck(), texts(Duck()) + ' q', _chain(kind).steps)} c"


_assembled_chain("npm", lambda d: views.command_lines(d, "npm"))
_assembled_chain("python", lambda d: views.command_lines(d, "python"))
_assembled_chain("generic", views.log_lines)


@native("s03_live_lines")
def live_lines(spark, sf_dir):
    """The turns of the conversations as files of two streams, read by the live source until nothing is left."""
    path, out, marks = (shared_path(spark, x) for x in ("live", "lines", "marks"))
    table(spark, sf_dir, "conversations").selectExpr("coalesce(text, '') as text", "coalesce(role, 'none') as role").write.partitionBy("role").text(path)
    spark.dataSource.register(live.LiveLines)
    lines = spark.readStream.format("lineflow_lines").option("path", path).option("stderr", "role=assistant").load()
    lines.writeStream.format("parquet").option("checkpointLocation", marks).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema("is_stderr boolean, line string").parquet(out).groupBy("is_stderr", "line").agg(F.count(F.lit(1)).alias("n"))


NATIVE_ORACLES["s03_live_lines"] = """select is_stderr, line, count(*) as n from (select coalesce(role, 'none') = 'assistant' as is_stderr, unnest(string_split(coalesce(text, ''), chr(10))) as line from conversations) l group by all"""


@native("k02_committed_log")
def committed_log(spark, sf_dir):
    """Three appends to a log of the events, the last of which makes it keep its newer half."""
    path = shared_path(spark, "committed")
    rows = spark.sql(f"select id, lpad(cast(us as string), 20, '0') as ts from {views.measurements(Spark(sf_dir))} m")
    n = rows.count()
    for k in range(3):
        sinks.commit_log(rows.where(F.col("id") % 3 == k), path, most=n - 1)
    return sinks.read_log(spark, path, "id long, ts string")


NATIVE_ORACLES["k02_committed_log"] = f"select id, lpad(us::varchar, 20, '0') as ts from {views.measurements(Duck())} m qualify row_number() over (order by us, id) > count(*) over () // 2"


def _registered(spark):
    """A user's chain, runs of equal lines as one with its count and then without blanks, and a user's aggregate."""

    class Runs:
        def __init__(self):
            self.last, self.n = None, 0

        def line(self, line):
            if line == self.last:
                self.n += 1
                return
            yield from self.end()
            self.last, self.n = line, 1

        def end(self):
            if self.n:
                yield self.last if self.n == 1 else f"{self.last} x{self.n}"

    user.register_chain(spark, "lineflow_runs", Runs, user.each(lambda x: [x] if x else []))
    user.register_fold(spark, "lineflow_longest", StringType(), LongType(), int, lambda n, x: max(n, len(x)), max, int)


@native("u05_user_chain")
def user_chain(spark, sf_dir):
    _registered(spark)
    d = Spark(sf_dir)
    return spark.sql(f"select * from lineflow_runs(table(select * from {generic.split_lines(d, views.documents(d) + ' v')} l))")


_RUNS = f"(select *, row_number() over w - row_number() over (partition by doc, line order by pos) as run from {generic.split_lines(Duck(), views.documents(Duck()) + ' v')} l window w as (partition by doc order by pos))"
NATIVE_ORACLES["u05_user_chain"] = f"""
with r as (select doc, line, min(pos) as first_pos, count(*) as n from {_RUNS} q group by doc, line, run),
t as (select doc, first_pos, line || case when n > 1 then ' x' || n else '' end as line from r)
select doc, row_number() over (partition by doc order by first_pos) - 1 as pos, line from t where line <> ''"""


@native("u05_user_fold")
def user_fold(spark, sf_dir):
    _registered(spark)
    d = Spark(sf_dir)
    documents = d.table("documents")
    rows = f"select source as key, line as value from {generic.split_lines(d, f'(select doc_id as doc, text, source from {documents}) v', 'source')} l"
    return spark.sql(f"select key as source, value as longest from lineflow_longest(table(select * from lineflow_longest_parts(table({rows}))))")


NATIVE_ORACLES["u05_user_fold"] = f"select source, coalesce(max(length(line)), 0) as longest from {generic.split_lines(Duck(), '(select doc_id as doc, text, source from documents) v', 'source')} l group by source"
