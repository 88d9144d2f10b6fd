"""Whole programs: the golden dispatch program, streaming, sources, lookups."""

from pointweave import schema
from pointweave.functions.context import CallString, NoContext
from pointweave.operators import delta, lookups, stats
from pointweave.plans import pointsto
from pointweave.program import Program
from pointweave.sources import scope
from pointweave.streaming.changelog import Maintainer, read_changes


def golden(spark):
    """main: p = new P; q = p.get(); r = q.m(). P.get: z = new Z; return z. Z.m: w = new W; return w."""
    f = lambda rows, s: spark.createDataFrame(rows, s)
    classes = f([(1, None), (2, None), (3, None), (9, None)], schema.CLASS)
    functions = f([(10, 9, True, 10), (11, 1, False, 1), (12, 2, False, 2)], schema.FUNCTION)
    params = f([(11, 0, 110), (12, 0, 120)], schema.PARAM)
    instr = [
        (1, 10, "alloc", 100, None, None, 1, None, None), (2, 10, "vcall", 101, 100, None, None, 1, []), (3, 10, "vcall", 102, 101, None, None, 2, []),
        (4, 11, "alloc", 111, None, None, 2, None, None), (5, 11, "return", None, 111, None, None, None, None),
        (6, 12, "alloc", 121, None, None, 3, None, None), (7, 12, "return", None, 121, None, None, None, None),
    ]
    return Program(classes, functions, params, f(instr, schema.INSTR), f([(10,)], schema.ENTRY))


def held(analysis):
    return {(r.node, r.heap) for r in analysis.pts.collect()}


def test_dispatch_reaches_the_fixpoint(spark):
    made = pointsto.build(golden(spark))
    assert {(r.instr_id, r.callee) for r in made.calls.collect()} == {(2, 11), (3, 12)}
    assert held(made) == {("H1", "H1"), ("H4", "H4"), ("H6", "H6"), ("V100", "H1"), ("V110", "H1"), ("V111", "H4"), ("V101", "H4"), ("V120", "H4"), ("V121", "H6"), ("V102", "H6")}


def test_single_shot_binds_once(spark):
    made = pointsto.build(golden(spark), dispatch="single_shot")
    assert {(r.instr_id, r.callee) for r in made.calls.collect()} == {(2, 11)}
    assert {n for n, _ in held(made)} == {"H1", "H4", "V100", "V110", "V111", "V101"}


def test_contexts_name_the_callee(spark):
    made = pointsto.build(golden(spark), CallString(2))
    assert ("V102@10", "H6@10.2") in held(made)
    assert made.policy.label == "2-context" and NoContext().label == "No context"


def test_stream_ends_where_the_batch_does(spark, tmp_path):
    state = delta.start(spark.createDataFrame([(1, 2), (2, 3)], "src bigint, dst bigint"), spark.createDataFrame([(1, 7)], "node bigint, heap bigint"))
    rows = spark.createDataFrame([(1, "add", 3, 4), (2, "del", 1, 2), (3, "add", 1, 4)], "seq bigint, op string, src bigint, dst bigint")
    rows.coalesce(1).write.parquet(str(tmp_path / "log"))
    keeper = Maintainer(state)
    keeper.attach(read_changes(spark, str(tmp_path / "log")), str(tmp_path / "ck")).awaitTermination(60)
    want, _ = delta.apply_changes(state, rows)
    assert lookups.equal_sets(keeper.state.pts, want.pts)
    assert {(r.node, r.heap) for r in want.pts.collect()} == {(1, 7), (4, 7)}


def test_sources(spark, tmp_path):
    (tmp_path / "scope.txt").write_text("Application,Java,jarFile,a.jar\n")
    (tmp_path / "ex.txt").write_text("java/awt/.*\n\nsun/.*\n")
    (tmp_path / "s.properties").write_text("# note\nruntime=.\n")
    assert scope.read_scope(spark, str(tmp_path / "scope.txt")).first().path == "a.jar"
    classes = spark.createDataFrame([("java.awt.X",), ("java.util.List",), ("sun.Y",)], "name string")
    assert [r.name for r in scope.excluded(classes, scope.read_exclusions(spark, str(tmp_path / "ex.txt"))).collect()] == ["java.util.List"]
    assert scope.read_settings(spark, str(tmp_path / "s.properties")) == {"runtime": "."}


def test_time_statistics(spark):
    t = spark.createDataFrame([("add", 2.0, 1), ("add", 4.0, 3), ("add", 9.0, 0), ("del", 1.0, 0)], "op string, ms double, affected int")
    assert [tuple(r) for r in stats.time_statistics(t).collect()] == [("add", 2, 6.0, 3.0, 4.0, 2.0)]


def test_program_round_trip(spark, tmp_path):
    golden(spark).write_parquet(str(tmp_path / "p"))
    assert Program.read_parquet(spark, str(tmp_path / "p")).instr.count() == 7


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    """A new maintainer on the same folder has the old one's state; a batch that comes again changes nothing."""
    schema = "seq bigint, op string, src bigint, dst bigint"
    state = delta.start(spark.createDataFrame([(1, 2)], "src bigint, dst bigint"), spark.createDataFrame([(1, 7)], "node bigint, heap bigint"))
    first = Maintainer(state, str(tmp_path / "state"))
    first(spark.createDataFrame([(1, "add", 2, 3)], schema), 0)
    again = Maintainer(state, str(tmp_path / "state"))
    assert again.last == 0
    again(spark.createDataFrame([(1, "del", 1, 2)], schema), 0)
    again(spark.createDataFrame([(2, "add", 3, 4)], schema), 1)
    assert {(r.node, r.heap) for r in again.state.pts.collect()} == {(n, 7) for n in (1, 2, 3, 4)}


def test_cyclic_hierarchies_end(spark):
    from pointweave.operators import fixpoint

    classes = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "class_id bigint, super_id bigint")
    got = {(r.class_id, r.ancestor): r.depth for r in fixpoint.ancestors(classes).collect()}
    assert got == {(1, 1): 0, (1, 2): 1, (1, 3): 2, (2, 2): 0, (2, 3): 1, (2, 1): 2, (3, 3): 0, (3, 1): 1, (3, 2): 2, (4, 4): 0, (4, 1): 1, (4, 2): 2, (4, 3): 3}


def test_checks_after_construction(spark, monkeypatch):
    monkeypatch.setenv("POINTWEAVE_VERIFY", "2")
    assert pointsto.build(golden(spark)).pts.count() == 10


def test_change_times_of_instructions(spark):
    from pointweave.plans import benchmark

    found = benchmark.measure(golden(spark), NoContext(), golden(spark).instr.where("instr_id in (1, 4, 5)"))
    assert found.nodes == 10 and found.total == 10 and set(found.phases) == {"initial graph"}
    got = {r.op: r for r in found.times(spark).collect()}
    assert got["del"].n == got["add"].n == 2 and got["del"].min_ms <= got["del"].mean_ms <= got["del"].max_ms <= got["del"].total_ms
