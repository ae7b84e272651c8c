"""Gates of lines: plain expressions for two pieces, the same hashes as by lambdas where lengths meet."""

from pyspark.sql import functions as F

from regionlake.llm import line_dedup


def test_gates_of_two_pieces_are_plain_and_meet_those_of_three(spark):
    cut = 2 * line_dedup.PIECE
    long = "".join(chr(97 + i * i % 23) for i in range(cut + 2))
    lines = [long[:n] for n in (20, 21, cut - 1, cut, cut + 1, cut + 2)]
    rows = spark.createDataFrame([(x,) for x in lines], "line string").withColumn("n", F.char_length("line"))
    rows = rows.withColumn("gates", line_dedup._gates(F.col("line"), F.col("n")))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert f"<= {cut}) THEN array(" in plan
    gates = {r.n: {g.gate for g in r.gates} for r in rows.collect()}
    # a line and the same line without its last character agree without the last piece
    assert all(gates[n] & gates[n + 1] for n in (20, cut - 1, cut, cut + 1))
    assert not gates[20] & gates[cut]
