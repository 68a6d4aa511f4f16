import pytest

from cadenza.plans.pipeline import Hook, Step, build, parse_channels, rewrite
from cadenza.queries import powers, voltages


def test_sums_fuse_and_selections_move_down():
    steps = [Step("detect"), Step("chan_pol_select", {"chan": (0, 1)}), Step("tscrunch", {"factor": 2}), Step("fscrunch", {"factor": 2}), Step("tscrunch", {"factor": 3})]
    out = rewrite(steps)
    assert [s.name for s in out] == ["chan_pol_select", "detect", "scrunch"] and out[-1].args == {"time": 6, "freq": 2}


def test_fused_plan_has_one_exchange(spark, sf_dir):
    s = build(powers(spark, sf_dir), [Step("tscrunch", {"factor": 2}), Step("fscrunch", {"factor": 2})])
    assert s.df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert (s.meta.nchan, s.meta.scale, s.meta.path) == (2, 4.0, ("scrunch",))


def test_selection_reaches_the_scan(spark, sf_dir):
    from cadenza.operators.selection import truncate

    plan = truncate(powers(spark, sf_dir), 50_000).df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,value:double>" in plan


def test_rewriting_keeps_results(spark, sf_dir):
    steps = [Step("detect", {"state": "Stokes"}), Step("chan_pol_select", {"chan": (1, 2)}), Step("chomp", {"ndat": 40})]
    from cadenza.plans.pipeline import OPERATORS

    plain = voltages(spark, sf_dir)
    for s in steps:
        plain = OPERATORS[s.name](plain, **s.args)
    rows = lambda x: sorted(map(tuple, x.df.select("idat", "ichan", "ipol", "v").collect()))
    assert rows(build(voltages(spark, sf_dir), steps)) == rows(plain)


def test_channel_options():
    assert (parse_channels("128:D").when, parse_channels("64:B").when, parse_channels("32").when, parse_channels("32:1024").points) == ("during", "before", "after", 1024)
    with pytest.raises(ValueError):
        parse_channels("x")


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_rfi_filter_zeroes_the_strong_channel(spark, sf_dir):
    from cadenza.queries import QUERIES

    rows = QUERIES["rfi_filter"](spark, sf_dir).groupBy("ichan").sum("v").toPandas().set_index("ichan")["sum(v)"]
    assert rows[77] == 0 and (rows > 0).sum() >= 120


def test_hooks_go_before_a_named_step_and_leave_fusion(spark, sf_dir, tmp_path):
    steps = [Step("detect"), Step("chan_pol_select", {"chan": (0, 1)}), Step("tscrunch", {"factor": 2}), Step("fscrunch", {"factor": 2}), Step("digitize", {"nbit": 8})]
    dump = Step("dump", {"path": str(tmp_path / "seen")})
    assert [s.name for s in rewrite(steps, [Hook("fscrunch", dump)])] == ["chan_pol_select", "detect", "dump", "scrunch", "digitize"]
    alone = rewrite(steps, [Hook("fscrunch", dump, alone=True)])
    assert [s.name for s in alone] == ["chan_pol_select", "detect", "scrunch", "dump", "scrunch", "digitize"] and alone[2].args == {"time": 2} and alone[4].args == {"freq": 2}
    assert [s.name for s in rewrite(steps, [Hook("detect", dump), Hook("digitize", dump)])] == ["chan_pol_select", "dump", "detect", "scrunch", "dump", "digitize"]
    with pytest.raises(ValueError, match="no step rescale"):
        rewrite(steps, [Hook("rescale", dump)])
    plain, hooked = build(voltages(spark, sf_dir), steps), build(voltages(spark, sf_dir), steps, [Hook("fscrunch", dump)])
    rows = lambda x: sorted(map(tuple, x.df.select("idat", "ichan", "ipol", "v").collect()))
    assert rows(plain) == rows(hooked) and spark.read.parquet(str(tmp_path / "seen")).count() == powers(spark, sf_dir).meta.ndat * 2
    assert hooked.df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_delay_steps(spark, sf_dir):
    from cadenza.operators import delays

    sig = powers(spark, sf_dir)
    rows = lambda x: sorted(map(tuple, x.df.select("idat", "ichan", "ipol", "v").collect()))
    assert rows(build(sig, [Step("sample_delay", {"dm": 5.0})])) == rows(delays.sample_delay(sig, delays.dispersion_delays(sig, 5.0)))
    shift = [(0, 0), (1, 2), (2, 1), (3, 0)]
    assert rows(build(sig, [Step("sample_delay", {"shift": shift})])) == rows(delays.sample_delay(sig, shift))
