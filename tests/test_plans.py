"""Tidy tables, summaries, external data, plot and report tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from freshet.functions import clock
from freshet.operators import spread
from freshet.plans import charts, external, quality, reports, summaries


def test_prevalence(spark):
    # --- fixed values: composite results and their counts ---
    rows = [
        ("A", "pA", "Fall", 1, "composite"), ("A", "pA", "Fall", 1, "composite"), ("A", "pA", "Summer", 1, "composite"),
        ("A", "pA", "Summer", 1, "composite"), ("A", "pA", "Spring", 1, "composite"), ("A", "pA", "Winter", 1, "composite"),
        ("B", "pA", "Summer", 1, "composite"), ("B", "pA", "Fall", 1, "composite"), ("B", "pA", "Fall", 1, "composite"),
        ("B", "pB", "Spring", 1, "composite"), ("B", "pB", "Winter", 1, "grab"), ("B", "pB", "Winter", 1, "composite"),
    ]
    df = spark.createDataFrame(rows, "site string, parameter string, season string, rescol int, sampletype string")
    got = summaries.prevalence_table(df, "rescol", "season").orderBy("site", "season")
    assert got.columns == ["site", "season", "pA", "pB"]
    assert [tuple(r) for r in got.collect()] == [
        ("A", "Fall", 2, None), ("A", "Spring", 1, None), ("A", "Summer", 2, None), ("A", "Winter", 1, None),
        ("B", "Fall", 2, None), ("B", "Spring", None, 1), ("B", "Summer", 1, None), ("B", "Winter", None, 1),
    ]


def test_remove_loads(spark):
    day = dt.datetime(2016, 1, 2, 12, 30)
    rows = [(day, 1.0, 1.0, 1.0, "g"), (day + dt.timedelta(hours=2), 2.0, 2.0, 2.0, "g"), (day + dt.timedelta(days=1), 3.0, 4.0, 5.0, "g")]
    df = spark.createDataFrame(rows, "date timestamp_ntz, conc double, load double, load_a double, load_units string")
    got = summaries.remove_load_data(df, ["2016-01-02"], "date").orderBy("date").collect()
    assert [(r["conc"], r["load"], r["load_a"], r["load_units"]) for r in got] == [(1, 1, None, None), (2, 2, None, None), (3, 4, 5, "g")]
    kept = summaries.remove_load_data(df, dt.date(2016, 1, 2), "date", keep_meta=True).orderBy("date").first()
    assert kept["load_units"] == "g" and kept["load_a"] is None


def test_load_reduction(spark):
    # --- fixed values: loads with bounds and their reductions ---
    cols = "A A_lo A_hi B B_lo B_hi".split()
    rows = [(75, 70, 80, 50, 45, 55, "A"), (50, 45, 55, 50, 45, 55, "B"), (25, 20, 30, 10, 5, 15, "A"), (10, 5, 15, 20, 15, 25, "B")]
    df = spark.createDataFrame([(*map(float, r[:6]), r[6], "A", "g", "summer") for r in rows],
                               ", ".join(f"{c} double" for c in cols) + ", site string, parameter string, load_units string, season string")
    got = summaries.load_reduction_pct(
        df, "season", load_inflow="A", load_outflow="B", load_inflow_lower="A_lo", load_inflow_upper="A_hi",
        load_outflow_lower="B_lo", load_outflow_upper="B_hi",
    ).orderBy("site").collect()
    assert [tuple(r[c] for c in ("load_red", "load_red_lower", "load_red_upper", "count")) for r in got] == [
        pytest.approx((40.0, 100 * 20 / 90, 100 * 60 / 110, 2)), pytest.approx((100 * -10 / 60, 100 * -30 / 50, 100 * 10 / 70, 2))
    ]
    with pytest.raises(ValueError):
        summaries.load_reduction_pct(df, "month")


# --- fixed values: influent lower/mid/upper, effluent lower/mid/upper -> mass reductions, percent reductions ---
KNOWN_TOTALS = [
    ((0.42678037048985024, 0.6940836130687156, 0.9493757832564462), (0.07128497999999951,) * 3,
     (0.35549539048985074, 0.6227986330687161, 0.8780908032564467), (83.29703404161256, 89.72962642284105, 92.49138420663255)),
    ((48293.14580742403, 114904.69153784378, 140542.58277252968), (69076.16189999998,) * 3,
     (-20783.01609257595, 45828.52963784381, 71466.4208725297), (-43.03512588608591, 39.88394992797157, 50.85036823906901)),
    ((0.06995494326635211, 0.09520358173003549, 0.11026010925425037), (0.005001664499999981, 0.010529819999999959, 0.014215256999999946),
     (0.055739686266352166, 0.08467376173003553, 0.10525844475425039), (79.67941029431526, 88.93968083064469, 95.46375880286263)),
]


# --- fixed values: known totals overall and by season; keys, influent, effluent, mass and percent reductions ---
TOTALS_OVERALL = """
ED-1,Cadmium (Cd),composite,Yes,g,0.42678037048985024,0.6940836130687156,0.9493757832564462,0.07128497999999951,0.07128497999999951,0.07128497999999951,0.35549539048985074,0.6227986330687161,0.8780908032564467,83.29703404161256,89.72962642284105,92.49138420663255
ED-1,Cadmium (Cd),unsampled,No,g,0.2138278561152297,0.4023559987438976,0.6557226365027932,0.0,0.0,0.0,0.2138278561152297,0.4023559987438976,0.6557226365027932,100.0,100.0,100.0
ED-1,Cadmium (Cd),unsampled,Yes,g,0.06995494326635211,0.09520358173003549,0.11026010925425037,0.005001664499999981,0.010529819999999959,0.014215256999999946,0.055739686266352166,0.08467376173003553,0.10525844475425039,79.67941029431526,88.93968083064469,95.46375880286263
ED-1,Total Suspended Solids,composite,Yes,g,123601.06322356258,159471.0768342024,191580.675282516,18687.451199999876,18687.451199999876,18687.451199999876,104913.6120235627,140783.62563420253,172893.22408251613,84.88083296969778,88.28160468281739,90.24564916454008
ED-1,Total Suspended Solids,unsampled,No,g,50112.37494150074,79215.6106621978,96228.36681316557,0.0,0.0,0.0,50112.37494150074,79215.6106621978,96228.36681316557,100.0,100.0,100.0
ED-1,Total Suspended Solids,unsampled,Yes,g,18994.388569009516,21820.38296586215,25480.2773486713,895.0346999999966,1368.8765999999948,3975.007049999984,15019.381519009532,20451.506365862155,24585.242648671305,79.0727296350805,93.72661514629878,96.48734318016884
LV-2,Cadmium (Cd),composite,Yes,g,0.24844570644823777,0.36603426520919535,0.5040091867915034,0.14513180699999997,0.14513180699999997,0.14513180699999997,0.1033138994482378,0.22090245820919538,0.35887737979150347,41.58409534429312,60.35021286407313,71.20453142453582
LV-2,Cadmium (Cd),unsampled,No,g,0.10385957534451207,0.1299766412177881,0.16771651377806024,0.0,0.0,0.0,0.10385957534451207,0.1299766412177881,0.16771651377806024,100.0,100.0,100.0
LV-2,Cadmium (Cd),unsampled,Yes,g,0.033489655269159466,0.033489655269159466,0.033489655269159466,0.0,0.0,0.0,0.033489655269159466,0.033489655269159466,0.033489655269159466,100.0,100.0,100.0
LV-2,Total Suspended Solids,composite,Yes,g,48293.14580742403,114904.69153784378,140542.58277252968,69076.16189999998,69076.16189999998,69076.16189999998,-20783.01609257595,45828.52963784381,71466.4208725297,-43.03512588608591,39.88394992797157,50.85036823906901
LV-2,Total Suspended Solids,unsampled,No,g,10668.03293588521,30706.666153907085,42254.26161117458,0.0,0.0,0.0,10668.03293588521,30706.666153907085,42254.26161117458,100.0,100.0,100.0
LV-2,Total Suspended Solids,unsampled,Yes,g,8439.393127828185,8439.393127828185,8439.393127828185,0.0,0.0,0.0,8439.393127828185,8439.393127828185,8439.393127828185,100.0,100.0,100.0
"""
TOTALS_BY_SEASON = """
ED-1,Cadmium (Cd),composite,Yes,g,autumn,0.023910645158061808,0.07377558035948985,0.11240046869174354,0.0028159379999998712,0.0028159379999998712,0.0028159379999998712,0.021094707158061936,0.07095964235948998,0.10958453069174368,88.22307812530755,96.18310288271742,97.49472752847453
ED-1,Cadmium (Cd),composite,Yes,g,spring,0.09290340767669406,0.19012790408253671,0.28627212830609217,0.025977953999999935,0.025977953999999935,0.025977953999999935,0.06692545367669411,0.16414995008253677,0.26029417430609225,72.03767369825248,86.33659055710065,90.9254337284895
ED-1,Cadmium (Cd),composite,Yes,g,summer,0.27095021271026914,0.3687435014037107,0.42706060016585473,0.034405631999999714,0.034405631999999714,0.034405631999999714,0.23654458071026943,0.334337869403711,0.392654968165855,87.30186197093333,90.66949468423813,91.94361830928963
ED-1,Cadmium (Cd),composite,Yes,g,winter,0.03901610494482519,0.061436627222978275,0.12364258609275593,0.008085455999999994,0.008085455999999994,0.008085455999999994,0.0309306489448252,0.05335117122297828,0.11555713009275594,79.2766192026752,86.83935566538406,93.46062205951084
ED-1,Cadmium (Cd),unsampled,No,g,autumn,0.03598764468236801,0.11103880111397307,0.16917268867779833,0.0,0.0,0.0,0.03598764468236801,0.11103880111397307,0.16917268867779833,100.0,100.0,100.0
ED-1,Cadmium (Cd),unsampled,No,g,spring,0.044697726273299945,0.09147441655931154,0.13773136584214518,0.0,0.0,0.0,0.044697726273299945,0.09147441655931154,0.13773136584214518,100.0,100.0,100.0
ED-1,Cadmium (Cd),unsampled,No,g,summer,0.04589986038870872,0.06246636629059364,0.07234547531465346,0.0,0.0,0.0,0.04589986038870872,0.06246636629059364,0.07234547531465346,100.0,100.0,100.0
ED-1,Cadmium (Cd),unsampled,No,g,winter,0.08724262477085301,0.13737641478001927,0.2764731066681962,0.0,0.0,0.0,0.08724262477085301,0.13737641478001927,0.2764731066681962,100.0,100.0,100.0
ED-1,Cadmium (Cd),unsampled,Yes,g,summer,0.06995494326635211,0.09520358173003549,0.11026010925425037,0.005001664499999981,0.010529819999999959,0.014215256999999946,0.055739686266352166,0.08467376173003553,0.10525844475425039,79.67941029431526,88.93968083064469,95.46375880286263
ED-1,Total Suspended Solids,composite,Yes,g,autumn,8174.579541217711,10831.317892113468,13283.691754478781,113.25959999999336,113.25959999999336,113.25959999999336,8061.319941217718,10718.058292113474,13170.432154478787,98.61449020798051,98.95433223243812,99.14737858952645
ED-1,Total Suspended Solids,composite,Yes,g,spring,38889.79856233705,54013.609114357016,67517.01139294627,7944.489599999986,7944.489599999986,7944.489599999986,30945.30896233706,46069.11951435703,59572.52179294628,79.5717903057131,85.29168902011342,88.23335121609074
ED-1,Total Suspended Solids,composite,Yes,g,summer,73569.26305378167,84514.93389836873,98690.47482824372,9686.398799999897,9686.398799999897,9686.398799999897,63882.86425378178,74828.53509836884,89004.07602824383,86.83363350681003,88.53883171505757,90.18507225053112
ED-1,Total Suspended Solids,composite,Yes,g,winter,2967.422066226142,10111.21592936315,12089.497306847245,943.3031999999993,943.3031999999993,943.3031999999993,2024.1188662261425,9167.912729363152,11146.194106847246,68.21135723373327,90.67072440555216,92.19733313918908
ED-1,Total Suspended Solids,unsampled,No,g,autumn,12303.468267476239,16302.095454406019,19993.135934648893,0.0,0.0,0.0,12303.468267476239,16302.095454406019,19993.135934648893,100.0,100.0,100.0
ED-1,Total Suspended Solids,unsampled,No,g,spring,18710.676114404632,25987.05015889532,32483.81269861915,0.0,0.0,0.0,18710.676114404632,25987.05015889532,32483.81269861915,100.0,100.0,100.0
ED-1,Total Suspended Solids,unsampled,No,g,summer,12462.875999583159,14317.108770252851,16718.492194562776,0.0,0.0,0.0,12462.875999583159,14317.108770252851,16718.492194562776,100.0,100.0,100.0
ED-1,Total Suspended Solids,unsampled,No,g,winter,6635.354560036708,22609.356278643598,27032.925985334732,0.0,0.0,0.0,6635.354560036708,22609.356278643598,27032.925985334732,100.0,100.0,100.0
ED-1,Total Suspended Solids,unsampled,Yes,g,summer,18994.388569009516,21820.38296586215,25480.2773486713,895.0346999999966,1368.8765999999948,3975.007049999984,15019.381519009532,20451.506365862155,24585.242648671305,79.0727296350805,93.72661514629878,96.48734318016884
LV-2,Cadmium (Cd),composite,Yes,g,autumn,0.011954559062848471,0.015370147366519461,0.018785735670190453,0.004440815999999998,0.004440815999999998,0.004440815999999998,0.007513743062848474,0.010929331366519465,0.014344919670190456,62.85253202018257,71.10752490458646,76.36070219466164
LV-2,Cadmium (Cd),composite,Yes,g,spring,0.1758498893173804,0.28135982290780864,0.3985930824527289,0.078497475,0.078497475,0.078497475,0.09735241431738041,0.20286234790780866,0.3200956074527289,55.36108933322964,72.10068083326853,80.30636294113073
LV-2,Cadmium (Cd),composite,Yes,g,summer,0.060641258068008894,0.0693042949348673,0.08663036866858413,0.06219351599999999,0.06219351599999999,0.06219351599999999,-0.0015522579319910967,0.007110778934867307,0.02443685266858414,-2.5597389985713135,10.260228376250089,28.20818270100008
LV-2,Cadmium (Cd),unsampled,No,g,autumn,0.011207937088963046,0.01441020482866677,0.017612472568370497,0.0,0.0,0.0,0.011207937088963046,0.01441020482866677,0.017612472568370497,100.0,100.0,100.0
LV-2,Cadmium (Cd),unsampled,No,g,spring,0.021172483962330353,0.03387597433972857,0.0479909636479488,0.0,0.0,0.0,0.021172483962330353,0.03387597433972857,0.0479909636479488,100.0,100.0,100.0
LV-2,Cadmium (Cd),unsampled,No,g,summer,0.07147915429321866,0.08169046204939276,0.10211307756174094,0.0,0.0,0.0,0.07147915429321866,0.08169046204939276,0.10211307756174094,100.0,100.0,100.0
LV-2,Cadmium (Cd),unsampled,Yes,g,winter,0.033489655269159466,0.033489655269159466,0.033489655269159466,0.0,0.0,0.0,0.033489655269159466,0.033489655269159466,0.033489655269159466,100.0,100.0,100.0
LV-2,Total Suspended Solids,composite,Yes,g,autumn,1451.6250290601718,2134.7426897943697,2390.9118125696946,1225.8131999999991,1225.8131999999991,1225.8131999999991,225.8118290601726,908.9294897943705,1165.0986125696954,15.555796058874128,42.57794132003439,48.73030475003072
LV-2,Total Suspended Solids,composite,Yes,g,spring,43376.306031620494,98475.93801773303,116060.92694947105,23295.867899999997,23295.867899999997,23295.867899999997,20080.438131620496,75180.07011773303,92765.05904947105,46.29356431822996,76.3435938068394,79.92789777550009
LV-2,Total Suspended Solids,composite,Yes,g,summer,3465.214746743365,14294.01083031638,22090.744010488954,44554.4808,44554.4808,44554.4808,-41089.26605325663,-30260.469969683618,-22463.736789511044,-1185.7639152630477,-211.70034309407222,-101.68845729616436
LV-2,Total Suspended Solids,unsampled,No,g,autumn,1360.963789374084,2001.4173373148294,2241.587417792609,0.0,0.0,0.0,1360.963789374084,2001.4173373148294,2241.587417792609,100.0,100.0,100.0
LV-2,Total Suspended Solids,unsampled,No,g,spring,5222.546044041488,11856.591018904997,13973.839415138034,0.0,0.0,0.0,5222.546044041488,11856.591018904997,13973.839415138034,100.0,100.0,100.0
LV-2,Total Suspended Solids,unsampled,No,g,summer,4084.5231024696377,16848.657797687254,26038.834778243938,0.0,0.0,0.0,4084.5231024696377,16848.657797687254,26038.834778243938,100.0,100.0,100.0
LV-2,Total Suspended Solids,unsampled,Yes,g,winter,8439.393127828185,8439.393127828185,8439.393127828185,0.0,0.0,0.0,8439.393127828185,8439.393127828185,8439.393127828185,100.0,100.0,100.0
"""


@pytest.mark.parametrize("text, season", [(TOTALS_OVERALL, None), (TOTALS_BY_SEASON, "season")])
def test_load_totals_on_all_known_rows(spark, text, season):
    """Loads that add up to the known sums give the known reductions, group by group."""
    keys = ["site", "parameter", "sampletype", "has_outflow", "load_units", *(["season"] if season else [])]
    bounds = ("_lower", "", "_upper")
    known = {}
    for line in text.strip().splitlines():
        cells = line.split(",")
        known[tuple(cells[: len(keys)])] = [float(x) if x else None for x in cells[len(keys) :]]
    rows = [(*k, *[share * x for x in v[:6]]) for k, v in known.items() for share in (0.25, 0.75)]
    names = [f"load_{p}{b}" for p in ("inflow", "outflow") for b in bounds]
    df = spark.createDataFrame(rows, ", ".join([f"{k} string" for k in keys] + [f"{n} double" for n in names]))
    df = df.withColumns({f"load_{p}{b}": F.lit(None).cast("double") for p in ("runoff", "bypass") for b in bounds})
    got = {tuple(r[k] for k in keys): r for r in summaries.load_totals(df, season).collect()}
    assert set(got) == set(known)
    for k, v in known.items():
        assert [got[k][f"reduct_mass{b}"] for b in bounds] == pytest.approx(v[6:9], rel=1e-9, abs=1e-9)
        for b, pct in zip(bounds, v[9:]):
            assert got[k][f"reduct_pct{b}"] is None if pct is None else got[k][f"reduct_pct{b}"] == pytest.approx(pct, rel=1e-9)


def totals_input(spark):
    rows = []
    for i, (inflow, outflow, *_) in enumerate(KNOWN_TOTALS):
        for share in (0.25, 0.75):  # two rows per group
            rows.append((f"s{i}", "p", "composite", "Yes", "g", "winter", *[share * x for x in (*inflow, *outflow)]))
    df = spark.createDataFrame(rows, "site string, parameter string, sampletype string, has_outflow string, load_units string, season string, "
                               + ", ".join(f"load_{p}{b} double" for p in ("inflow", "outflow") for b in ("_lower", "", "_upper")))
    return df.withColumns({f"load_{p}{b}": F.lit(None).cast("double") for p in ("runoff", "bypass") for b in ("_lower", "", "_upper")}).withColumns(
        {"year": F.lit("2012"), "grouped_season": F.lit("winter/spring"), "storm_bin": F.lit(None).cast("string")})


def test_load_totals_reproduce_known_reductions(spark):
    got = summaries.load_totals(totals_input(spark)).orderBy("site").collect()
    for row, (_, _, mass, pct) in zip(got, KNOWN_TOTALS, strict=True):
        assert [row[f"reduct_mass{b}"] for b in ("_lower", "", "_upper")] == pytest.approx(mass, rel=1e-9)
        assert [row[f"reduct_pct{b}"] for b in ("_lower", "", "_upper")] == pytest.approx(pct, rel=1e-9)
        assert row["load_bypass"] == 0.0
    assert summaries.load_totals(totals_input(spark), na_value=None).first()["load_bypass"] is None
    titled = summaries.with_headings(summaries.load_totals(totals_input(spark)), summaries.LOAD_TOTAL_HEADINGS)
    assert "Load Reduction Percent (upper bound)" in titled.columns and "Runoff Load (upper bound" in titled.columns


def test_groupings_in_one_pass_equal_the_single_reports(spark):
    df = totals_input(spark)
    one = summaries.load_totals_at_groupings(df)
    for tag, column in {"overall": None, "year": "year", "season": "season", "grouped_season": "grouped_season"}.items():
        a = one.filter(F.col("grouping") == tag).select("site", "load_inflow", "reduct_pct").orderBy("site").collect()
        b = summaries.load_totals(df, column).select("site", "load_inflow", "reduct_pct").orderBy("site").collect()
        assert [tuple(r) for r in a] == [tuple(r) for r in b]
    assert one.filter("grouping = 'storm_bin'").count() == 0  # its key is unknown everywhere


def grouped_input(spark):
    rng, rows = random.Random(2), []
    for k in range(600):
        season = rng.choice(["winter", "spring", "summer", None])
        rows.append((
            rng.choice(["A", "B", None]), rng.choice(["Zn", "Cu"]), "ug/L", "g", rng.choice(["composite", "grab"]), rng.choice(["=", "<", None]),
            rng.choice([None, 1.0, 2.0, 2.5, rng.random()]), season, season and f"{season}+", rng.choice(["2012", "2013"]),
            None if k % 2 else rng.choice(["small", "large"]), k, 5.0 + k % 3, *(rng.random() for _ in range(6)),
        ))
    loads = ", ".join(f"load_{side}{b} double" for side in ("inflow", "outflow") for b in ("_lower", "", "_upper"))
    return spark.createDataFrame(
        rows, "site string, parameter string, units string, load_units string, sampletype string, qualifier string, concentration double, "
        f"season string, grouped_season string, year string, storm_bin string, storm_number int, total_precip_depth double, {loads}"
    ).withColumn("start_date", F.lit("2012-01-01").cast("timestamp"))


REPORTS = {
    "prevalence": (summaries.prevalence_at_groupings, summaries.prevalence_counts),
    "reduction": (summaries.load_reduction_at_groupings, summaries.load_reduction_pct),
    "quality": (summaries.wq_summary_at_groupings, summaries.wq_summary),
    "storms": (lambda df: summaries.storm_stats_at_groupings(df, 5.5), lambda df, groupby_col: summaries.storm_stats(df, 5.5, None, groupby_col)),
}


@pytest.mark.parametrize("report", REPORTS)
def test_rolled_up_groupings_equal_the_single_reports(spark, report):
    df = grouped_input(spark)
    all_at_once, single = REPORTS[report]
    found = all_at_once(df)
    names = [c for c in found.columns if c not in ("grouping", "group_value")]
    rows = found.collect()
    assert {r.grouping for r in rows} == set(summaries.GROUPINGS)

    def key(values):
        return tuple(round(v, 9) if isinstance(v, float) else v for v in values)

    for name, column in summaries.GROUPINGS.items():
        mine = sorted(repr((r.group_value, *key(r[c] for c in names))) for r in rows if r.grouping == name)
        theirs = single(df, groupby_col=column).collect()
        assert mine == sorted(repr((r[column] if column else "All", *key(r[c] for c in names))) for r in theirs), name
    assert all_at_once(df.limit(0)).count() == 0


def test_rows_are_not_multiplied_by_the_groupings(spark, monkeypatch):
    counted = []
    monkeypatch.setattr(summaries, "cut", lambda df: counted.append(df) or df)
    summaries.prevalence_at_groupings(grouped_input(spark))
    plan = counted[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Expand" not in plan and "Union" not in plan


def test_grouped_statistics_keep_few_values(spark, monkeypatch):
    kept = []
    for module in (summaries, spread):
        monkeypatch.setattr(module, "cut", lambda df, real=module.cut: kept.append(real(df)) or kept[-1])
    n = 12_000
    df = spark.range(n).selectExpr(
        "'A' AS site", "CAST(id AS INT) AS storm_number", "timestamp_ntz'2011-03-01' + make_dt_interval(CAST(id % 90 AS INT)) AS start_date",
        "10 + id / 7 AS total_precip_depth", "CAST('a' AS STRING) AS storm_bin",
    )
    found = summaries.storm_stats_at_groupings(clock.with_time_groups(df, "start_date"), 1, group_rows=1000).collect()
    overall = next(r for r in found if r.grouping == "Overall")
    assert (overall["count"], overall.p25, overall.p50) == (n, pytest.approx(10 + (n - 1) / 28), pytest.approx(10 + (n - 1) / 14))
    assert max(k.count() for k in kept) < n  # of 60,000 rows at five groupings


def test_storm_stats_describe(spark):
    # --- fixed values: known storms and their statistics ---
    rows = """2,3.1041,2011-07-28 08:30,2.000,6.0,5.0000,16.4213
    3,0.6458,2011-07-29 02:00,10.333,3.6,2.2,7.22535
    5,2.6736,2011-08-03 03:20,2.000,12.0,12.8,42.0384
    8,2.7361,2011-08-07 04:10,19.833,38.4,26.6,87.36105
    9,1.2638,2011-08-09 06:20,8.166,20.4,34.6,113.63505
    10,0.3472,2011-08-09 22:50,0.833,14.4,5.800,19.04865
    14,0.4027,2011-08-21 13:50,2.833,28.8,6.0,19.7055
    17,0.4166,2011-08-24 20:20,2.166,27.6,11.2,36.7836
    19,6.7430,2011-09-01 01:10,1.333,4.8,5.0,16.42125
    21,1.8402,2011-09-03 09:20,5.500,14.4,4.4,14.4507
    24,0.2638,2011-09-04 19:00,0.833,10.8,4.0,13.137"""
    parsed = [r.strip().split(",") for r in rows.splitlines()]
    df = spark.createDataFrame(
        [("ED-1", int(r[0]), 2011, "summer", float(r[1]), dt.datetime.fromisoformat(r[2]), *map(float, r[3:])) for r in parsed],
        "site string, storm_number int, year int, season string, antecedent_days double, start_date timestamp_ntz, duration_hours double, "
        "peak_precip_intensity double, total_precip_depth double, runoff_m3 double",
    )
    got = summaries.storm_stats(df, 8, [dt.date(2011, 8, 21)], "season").collect()
    table = {r["quantity"]: r for r in got}
    assert sorted(table) == ["antecedent_days", "duration_hours", "peak_precip_intensity", "runoff_m3", "total_precip_depth", "year"]
    for quantity, known in {
        "antecedent_days": (4, 1.7726, 1.1310, 0.4166, 1.0520, 1.9687, 2.689225, 2.7361),
        "duration_hours": (4, 8.0417, 8.3681, 2.0, 2.125, 5.16667, 11.08275, 19.833),
        "peak_precip_intensity": (4, 24.6, 11.19285, 12.0, 18.3, 24.0, 30.3, 38.4),
        "runoff_m3": (4, 69.9545, 36.9260, 36.7836, 40.7247, 64.6997, 93.92955, 113.635),
        "total_precip_depth": (4, 21.3, 11.24334, 11.2, 12.4, 19.7, 28.6, 34.6),
        "year": (4, 2011.0, 0.0, 2011.0, 2011.0, 2011.0, 2011.0, 2011.0),
    }.items():
        assert [table[quantity][c] for c in ("count", "mean", "std", "min", "p25", "p50", "p75", "max")] == pytest.approx(known, rel=1e-3)


def wq_rows(spark):
    rows = [("s", "p", "u", "composite", q, c, "winter") for c, q in ((1.0, "="), (2.0, "<"), (3.0, None), (10.0, "="), (None, "="))]
    rows += [("s", "p", "u", "grab", "=", 99.0, "winter"), (None, "p", "u", "composite", "=", 5.0, "winter")]
    return spark.createDataFrame(rows, "site string, parameter string, units string, sampletype string, qualifier string, concentration double, season string")


def test_wq_summary(spark):
    r = summaries.wq_summary(wq_rows(spark)).first()
    assert (r["count"], r["count_nds"], r["mean"], r["min"], r["max"]) == (4, 2, 4.0, 1.0, 10.0)
    assert (r["p10"], r["p25"], r["p50"], r["p75"]) == pytest.approx((1.3, 1.75, 2.5, 4.75))
    assert r["cov"] == pytest.approx(r["std"] / 4)
    assert summaries.wq_summary(wq_rows(spark)).count() == 1  # unknown sites form no group
    titled = summaries.with_headings(summaries.wq_summary(wq_rows(spark), groupby_col="season"), summaries.WQ_SUMMARY_HEADINGS)
    assert titled.columns == ["site", "parameter", "units", "season", *summaries.WQ_SUMMARY_HEADINGS.values()]
    with pytest.raises(ValueError):
        summaries.wq_summary(wq_rows(spark), sampletype="unsampled")


def tidy_inputs(spark):
    day = dt.datetime(2024, 1, 5)
    cols = ("antecedent_days duration_hours peak_precip_intensity total_precip_depth runoff_m3 bypass_m3 inflow_m3 outflow_m3 "
            "outflow_mm peak_outflow centroid_lag_hours peak_lag_hours sm_est_peak_inflow").split()
    storms = spark.createDataFrame(
        [("a", n, "2024", "winter", "winter/spring", day, day, "Yes", *[float(n)] * len(cols)) for n in (1, 2)],
        "site string, storm_number int, year string, season string, grouped_season string, start_date timestamp_ntz, end_date timestamp_ntz, "
        "has_outflow string, " + ", ".join(f"{c} double" for c in cols),
    )
    wq = spark.createDataFrame(
        [("a", n, "2024", "winter", "winter/spring", p, u, f"smp{i}", t, day, day, 10, 0.1, "=", c)
         for i, (n, p, u, t, c) in enumerate([(1, "Copper (Cu)", "ug/L", "composite", 5.0), (2, "Nitrate (N)", "mg/L", "grab", 7.0),
                                               (None, "Copper (Cu)", "ug/L", "composite", 6.0)])],
        "site string, storm_number int, year string, season string, grouped_season string, parameter string, units string, sample string, "
        "sampletype string, samplestart timestamp_ntz, samplestop timestamp_ntz, interval_minutes int, detectionlimit double, qualifier string, concentration double",
    )
    medians = [("a", "Copper (Cu)", "winter", "ug/L", 1.0, 2.0, 3.0), ("a", "Copper (Cu)", "summer", "ug/L", 1.0, 2.0, 3.0)]
    ddl = "site string, parameter string, season string, units string, {0}_lower double, {0}_median double, {0}_upper double"
    return storms, wq, spark.createDataFrame(medians, ddl.format("influent")), spark.createDataFrame(medians, ddl.format("effluent"))


def test_tidy_measured(spark):
    storms, wq, influent, _ = tidy_inputs(spark)
    got = {(r["storm_number"], r["parameter"]): r for r in quality.tidy_measured(wq, storms, influent).collect()}
    assert set(got) == {(1, "Copper (Cu)"), (2, "Nitrate (N)")}
    copper = got[1, "Copper (Cu)"]
    assert (copper["load_outflow"], copper["load_inflow_upper"], copper["load_units"]) == (pytest.approx(0.005), pytest.approx(0.003), "g")
    assert got[2, "Nitrate (N)"]["load_inflow"] is None and got[2, "Nitrate (N)"]["load_outflow"] == 14.0
    assert quality.tidy_measured(wq, storms).filter("influent_median IS NOT NULL").count() == 0


def test_tidy_loads(spark):
    storms, wq, influent, effluent = tidy_inputs(spark)
    rows = quality.tidy_loads(wq, storms, influent, effluent).collect()
    inside = {(r["storm_number"], r["parameter"]): r for r in rows if r["has_outflow"]}
    assert set(inside) == {(n, p) for n in (1, 2) for p in ("Copper (Cu)", "Nitrate (N)")}
    measured, estimated = inside[1, "Copper (Cu)"], inside[2, "Copper (Cu)"]
    assert (measured["sampletype"], measured["load_outflow_lower"]) == ("composite", pytest.approx(0.005))
    assert (estimated["sampletype"], estimated["load_outflow_lower"], estimated["load_outflow_upper"]) == ("unsampled", pytest.approx(0.002), pytest.approx(0.006))
    assert inside[2, "Nitrate (N)"]["load_outflow"] is None  # a grab is no composite
    outside = [r for r in rows if not r["has_outflow"]]
    assert sorted((r["site"] or "", r["season"], r["sampletype"]) for r in outside) == [("", "summer", "unsampled"), ("a", "winter", "composite")]
    only = quality.tidy_loads(wq, storms, influent, effluent, keep_unmatched=False)
    assert only.count() == 4
    sums = quality.unsampled_estimates(only).filter("parameter = 'Copper (Cu)'").first()
    assert sums["load_outflow"] == pytest.approx(0.004) and sums["duration_hours"] == 2.0
    with pytest.raises(ValueError):
        quality.tidy_loads(wq, storms, influent.drop("site"), effluent)


def test_external_scans(spark):
    raw = spark.createDataFrame(
        [("Copper", "Total", 1, "Residential"), ("Copper", "Dissolved", 1, "Residential"), ("Copper", "Total", 2, "Residential"),
         ("Copper", "Total", 1, "Unknown"), ("E. Coli", "Total", 1, "Freeway"), ("junk", "Total", 1, "Freeway")],
        "parameter string, fraction string, epa_rain_zone int, primary_landuse string",
    )
    assert sorted(r["parameter"] for r in external.landuse_rows(raw).collect()) == ["Copper (Cu)", "Escherichia coli"]
    bmp = spark.createDataFrame(
        [("Copper, Total", "Bioretention", "outflow", 1), ("Copper, Total", "Bioretention", "inflow", 1),
         ("Copper, Total", "Rain Barrel", "outflow", 1), ("Copper, Total", "LID", "outflow", 2)],
        "parameter string, category string, station string, epazone int",
    )
    assert [tuple(r) for r in external.facility_data(bmp).select("parameter", "category").collect()] == [("Copper (Cu)", "Bioretention")]


def test_reduction_bars(spark):
    rows = [("LV-2", "Cadmium (Cd)", "autumn", 10, 0, 20), ("LV-2", "Cadmium (Cd)", "summer", 20, 15, 30), ("LV-4", "Cadmium (Cd)", "autumn", 50, 45, 60),
            ("LV-4", "Copper (Cu)", "summer", 80, 75, 100)]
    df = spark.createDataFrame(rows, "site string, parameter string, season string, load_red int, load_red_lower int, load_red_upper int")
    got = charts.reduction_bars(df, ["Cadmium (Cd)"], "season").orderBy("site", "season").collect()
    assert [(r["err_low"], r["err_high"], r["x"]) for r in got] == [(10, 10, -0.2), (5, 10, 0.8), (5, 10, 0.2)]


def test_probability_positions(spark):
    df = spark.createDataFrame([("p", "s", v) for v in (3.0, 1.0, 1.0, 9.0)], "parameter string, site string, v double")
    got = [r["probability"] for r in charts.probability_positions(df, "v").orderBy("probability").collect()]
    tail = 0.5 ** 0.25
    assert got == pytest.approx([100 * (1 - tail), 100 * (2 - 0.3175) / 4.365, 100 * (3 - 0.3175) / 4.365, 100 * tail])


def test_box_stats(spark):
    df = spark.createDataFrame([("p", "s", float(v)) for v in (1, 2, 3, 4, 5, 100)], "parameter string, site string, concentration double")
    r = charts.box_stats(df, group_rows=2).first()
    assert (r["q1"], r["median"], r["q3"]) == pytest.approx((2.25, 3.5, 4.75))
    assert (r["whisker_low"], r["whisker_high"], r["outliers"], r["count"]) == (1.0, 5.0, 1, 6)


def test_histogram_has_open_ends(spark):
    df = spark.createDataFrame([("s", v) for v in (0.0, 5.0, 5.1, 25.0, 25.1, 400.0, None)], "site string, total_precip_depth double")
    got = {r["bin"]: r["storms"] for r in charts.storm_histogram(df, units="mm").collect()}
    assert got == {"<5 mm": 2, "5 - 10 mm": 1, "20 - 25 mm": 1, ">25 mm": 2}


def test_sample_table(spark):
    # --- fixed values: results of one sample and their texts ---
    cases = [
        ("Aluminum (Al)", "ug/L", "g", 786.0, 0.5, 40.642016399999555, ("786 ug/L", "0.500 ug/L", "40.6 g")),
        ("Cadmium (Cd)", "ug/L", "g", 0.16, 0.01, 0.0082731839999999109, ("0.160 ug/L", "0.0100 ug/L", "0.00827 g")),
        ("Copper (Cu)", "ug/L", "g", 8.60, 0.20, 0.44468363999999516, ("8.60 ug/L", "0.200 ug/L", "0.445 g")),
        ("Dissolved Chloride (Cl)", "mg/L", "g", 140.0, 1.0, 7239.0359999999218, ("140 mg/L", "1.00 mg/L", "7,240 g")),
        ("Escherichia coli", "CFU/100mL", "CFU", 9000.0, None, 4653665999.9999495, None),
        ("Iron (Fe)", "ug/L", "g", 1350.0, 5.0, 69.80498999999925, ("1,350 ug/L", "5.00 ug/L", "69.8 g")),
        ("Lead (Pb)", "ug/L", "g", 6.13, 0.05, 0.31696636199999656, ("6.13 ug/L", "0.0500 ug/L", "0.317 g")),
        ("Nickel (Ni)", "ug/L", "g", 2.20, 0.2, 0.11375627999999877, ("2.20 ug/L", "0.200 ug/L", "0.114 g")),
        ("Nitrate (N)", "mg/L", "g", 1.40, 0.1, 72.390359999999205, ("1.40 mg/L", "0.100 mg/L", "72.4 g")),
        ("Nitrate + Nitrite", "mg/L", "g", 1.5, 0.1, 77.561099999999158, ("1.50 mg/L", "0.100 mg/L", "77.6 g")),
        ("Orthophosphate (P)", "mg/L", "g", 0.052, 0.002, 2.6887847999999708, ("0.0520 mg/L", "0.00200 mg/L", "2.69 g")),
        ("Total Kjeldahl Nitrogen (TKN)", "mg/L", "g", 1.2, 0.1, 62.048879999999322, ("1.20 mg/L", "0.100 mg/L", "62.0 g")),
        ("Total Oil & Grease", "mg/L", "g", 0.5, 0.5, 0.025853699999999719, ("0.500 mg/L", "0.500 mg/L", "0.0259 g")),
        ("Total Phosphorus", "mg/L", "g", 0.13, 0.1, 6.7219619999999276, ("0.130 mg/L", "0.100 mg/L", "6.72 g")),
        ("Total Suspended Solids", "mg/L", "g", 110.0, 3.0, 5687.8139999999385, ("110 mg/L", "3.00 mg/L", "5,690 g")),
        ("Zinc (Zn)", "ug/L", "g", 43.4, 0.5, 2.2441011599999756, ("43.4 ug/L", "0.500 ug/L", "2.24 g")),
    ]
    tidy = spark.createDataFrame([("s", "x", *c[:2], c[2], *c[3:6]) for c in cases] * 2,
                                 "site string, sample string, parameter string, units string, load_units string, concentration double, detectionlimit double, load_outflow double")
    guide = spark.createDataFrame([(c[0], 10.0) for c in cases], "parameter string, upper_limit double")
    got = {r["parameter"]: r for r in reports.wq_tables(tidy, guide).collect()}
    assert len(got) == 15
    for name, units, _, _, _, _, texts in cases:
        if texts:
            r = got[name]
            assert (r["effluent_emc"], r["detection_limit"], r["effluent_load"]) == texts and r["wq_guideline"] == f"10.0 {units}"


def test_storm_report(spark):
    # --- fixed values: a storm and the lines of its report ---
    storm = spark.createDataFrame(
        [("test", 2, dt.datetime(2013, 5, 19, 6, 10), 0.17708333, 5.75, 41.0, 1.32, 0.75, 876600.0, 291900.0, 1.39)],
        "site string, storm_number int, start_date timestamp_ntz, antecedent_days double, duration_hours double, peak_outflow double, "
        "peak_precip_intensity double, peak_lag_hours double, inflow_m3 double, outflow_m3 double, total_precip_depth double",
    )
    lines = [f"{r['label']},{r['text']}" for r in reports.hydro_tables(storm).orderBy("ord").collect()]
    assert lines == [
        "Site,test", "Event Date,2013-05-19 06:10", "Antecedent Dry Period,0.2 days", "Event Duration,5.8 hr",
        "Peak Effluent Flow,41.0 L/s", "Peak Precipitation Intensity,1 mm/hr", "Lag Time,0.8 hr",
        "Estimated Total Influent Volume,876600 m$^3$", "Total Effluent Volume,291900 m$^3$", "Total Precipitation,1.4 mm",
    ]
    no_lag = reports.hydro_tables(storm.withColumn("peak_lag_hours", F.lit(None).cast("double"))).filter("ord = 7").first()
    assert no_lag["text"] == "-- hr"


def test_report_names(spark):
    # --- fixed values: a sample and the names of its tables ---
    df = spark.createDataFrame(
        [("Test Site", "x", "composite", dt.datetime(2013, 2, 24, 16, 59), 3), ("Test Site", "y", "composite", dt.datetime(2013, 2, 24), None)],
        "site string, sample string, sampletype string, samplestart timestamp_ntz, storm_number int",
    )
    (r,) = reports.report_worklist(df, "composite").collect()
    assert (r["general_table"], r["hydro_table"]) == ("TestSite-2013-02-24-1659-1-General", "TestSite-2013-02-24-1659-2-Hydro")
    assert (r["wq_table"], r["storm_figure"]) == ("TestSite-2013-02-24-1659-3-WQComposite", "TestSite-2013-02-24-1659-Composite")
    assert r["document"] == "TestSite-20130224-1659-Composite-ISR-draft"
    with pytest.raises(ValueError):
        reports.report_worklist(df, "composite", "wrong")


def test_sites_are_stacked(spark):
    one = spark.createDataFrame([("a", 1)], "site string, x int")
    two = spark.createDataFrame([("b", 2, "s")], "site string, x int, season string")
    got = summaries.collect_sites([one, two]).orderBy("site").collect()
    assert [tuple(r) for r in got] == [("a", 1, None), ("b", 2, "s")]


def test_pair_bins(spark):
    hydro = spark.createDataFrame(
        [("a", "2020", "winter", 1.0, 11.0), ("a", "2020", "winter", 4.9, 12.0), ("a", "2021", "winter", 5.0, None)],
        "site string, year string, season string, p double, q double",
    )
    got = {tuple(r) for r in charts.pair_bins(hydro, {"p": 5, "q": 10}, ("season", "year")).collect()}
    assert got == {("a", "season", "winter", "p", "q", 0.0, 10.0, 2), ("a", "year", "2020", "p", "q", 0.0, 10.0, 2)}
