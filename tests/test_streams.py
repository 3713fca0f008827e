"""Streams fed in several micro-batches against the batch operators."""

from pyspark.sql import functions as F

from examlens.operators import quiz as z
from examlens.registry import quiz as rz
from examlens.registry.fixtures import view
from examlens.streaming import streams as st


def replay(spark, df, path, order, parts=4):
    """Write the rows as files in order and read them one per micro-batch."""
    n = df.count()
    numbered = df.withColumn("_i", F.row_number().over(__import__("pyspark").sql.Window.orderBy(order)))
    for p in range(parts):
        part = numbered.filter((F.col("_i") > n * p // parts) & (F.col("_i") <= n * (p + 1) // parts)).drop("_i")
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def sink(df, path):
    return df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/ck")


def test_answers_in_any_order(spark, sf_dir, tmp_path):
    att = view(spark, sf_dir, "fx_answers")
    shuffled = replay(spark, att, str(tmp_path / "in"), F.hash("event_id"))
    run(st.stream_answers(shuffled, str(tmp_path / "up"), str(tmp_path / "ck"), "3650 days"))
    known, sessions = rz._known(spark, sf_dir), rz._sessions(spark, sf_dir)
    got = st.read_first_answers(spark.read.parquet(str(tmp_path / "up")).drop("batch"), sessions, known)
    want = z.first_answers(att, sessions, known)
    assert sorted(got.select(*want.columns).collect()) == sorted(want.collect())


def test_sessions_end_once(spark, tmp_path):
    rows = [(1, n, n, n, n % 2 == 0, False, 3) for n in (1, 2)] + [(1, 2, 3, 3, True, False, 3), (1, 3, 4, 4, True, False, 3), (1, 1, 5, 5, True, False, 3)]
    rows += [(2, 1, 6, 6, True, False, 3), (2, None, 7, 7, None, True, 3), (2, 2, 8, 8, True, False, 3)]
    df = spark.createDataFrame(rows, "session_id bigint, q_order int, event_id bigint, s bigint, is_correct boolean, is_finish boolean, total_questions int")
    df = df.withColumn("answered_at", F.timestamp_seconds("s")).drop("s")
    stream = replay(spark, df, str(tmp_path / "in"), F.col("event_id"), parts=8)
    run(sink(st.stream_sessions(stream), str(tmp_path)))
    out = spark.read.parquet(str(tmp_path / "out"))
    done = {r.session_id: (r.answered, r.correct, r.score) for r in out.filter("answered is not null").collect()}
    assert done == {1: (3, 2, 66.67), 2: (1, 1, 33.33)}
    assert out.filter("answered is null").groupBy().sum("rejected").collect()[0][0] == 2


def test_status_feed(spark, tmp_path):
    path = ["start", "publish", "extracted", "publish", "start"]
    rows = [(7, i, ev, 2, i) for i, ev in enumerate(path)]
    df = spark.createDataFrame(rows, "exam_id bigint, event_id bigint, event string, question_count int, s bigint")
    df = df.withColumn("at", F.timestamp_seconds("s")).drop("s")
    run(sink(st.stream_status(replay(spark, df, str(tmp_path / "in"), F.col("event_id"), 3)), str(tmp_path)))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("at").collect()
    assert [(r.old_status, r.new_status, r.terminal) for r in got] == [
        ("queued", "processing", False), ("processing", "reviewing", False), ("reviewing", "completed", True)]
