"""Balance files: columns out of headers, records by white space, broken records left out."""

import pytest

from ensolith.sources import balance as B

HEAD = '"Time [h]","dt_flow [h]","Global Water Mass [kg]","Region soil Water Mass [kg]","east Water Mass [kg]","east Water Mass [kg/h]","east Tracer [mol/h]"'


def record(*values):
    return "".join(f"{v:16.8E}" for v in values)


def write(folder, name, lines):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def test_columns(spark, tmp_path):
    write(tmp_path / "a", "x-mas.dat", [HEAD, record(0, 1, 2, 3, 4, 5, 6), HEAD])
    write(tmp_path / "a", "notes.dat", ['"no","balance"'])
    got = [tuple(r)[1:] for r in B.balance_columns(spark, str(tmp_path)).orderBy("place").collect()]
    assert got == [
        (0, "Time [h]", "Time", "Time", "h", "time", False),
        (1, "dt_flow [h]", "dt_flow", "dt_flow", "h", "time", False),
        (2, "Global Water Mass [kg]", "", "Water Mass", "kg", "global", False),
        (3, "Region soil Water Mass [kg]", "soil", "Water Mass", "kg", "region", False),
        (4, "east Water Mass [kg]", "east", "Water Mass", "kg", "coupler", False),
        (5, "east Water Mass [kg/h]", "east", "Water Mass", "kg/h", "coupler", True),
        (6, "east Tracer [mol/h]", "east", "Tracer", "mol/h", "coupler", True),
    ]


def test_a_scope_alone_is_its_own_variable(spark, tmp_path):
    write(tmp_path, "x-mas.dat", ['"Time [h]","outlet [kg/h]",""'])
    got = [(r["scope"], r["variable"], r["is_rate"]) for r in B.balance_columns(spark, str(tmp_path)).orderBy("place").collect()]
    assert got == [("Time", "Time", False), ("outlet", "outlet", True)]


def test_series(spark, tmp_path):
    write(tmp_path / "1", "x-mas.dat", [HEAD, record(0, 1, 2, 3, 4, 5, 6), "", record(1, 1, 2, 3, -40, 50, 60), record(2, 1, 2), record(3, 1, 2, 3, 400, 0, 0).replace("4.00000000E+02", "     *********")])
    write(tmp_path / "2", "y-mas.dat", ['"Time [h]","east Water Mass [kg]"', record(7, 8), record(9, 10, 11)])
    write(tmp_path / "3", "z-mas.dat", ['"Time [h]","west Water Mass [kg]"', record(7, 8)])
    df = B.balance_series(spark, str(tmp_path), [("east", "Water Mass", False), ("east", "Tracer", True)])
    got = sorted((r["source"].rsplit("/", 1)[1], r["time"], r["name"], r["value"]) for r in df.collect())
    assert got == [
        ("x-mas.dat", 0.0, "east Tracer [mol/h]", 6.0), ("x-mas.dat", 0.0, "east Water Mass [kg]", 4.0),
        ("x-mas.dat", 1.0, "east Tracer [mol/h]", 60.0), ("x-mas.dat", 1.0, "east Water Mass [kg]", -40.0),
        ("x-mas.dat", 3.0, "east Tracer [mol/h]", 0.0), ("y-mas.dat", 7.0, "east Water Mass [kg]", 8.0),
    ]


def test_refusals(spark, tmp_path):
    write(tmp_path, "x-mas.dat", ['"Time [h]","east Water Mass [kg/h]","east Water Mass [g/h]"', record(0, 1, 2)])
    with pytest.raises(Exception, match="several columns"):
        B.balance_series(spark, str(tmp_path), [("east", "Water Mass", True)]).collect()
    with pytest.raises(ValueError):
        B.balance_series(spark, str(tmp_path), [])
