from leafmill.llm.format_duplicates import collapse, components
from leafmill.llm.lookalikes import Lookalikes

TEXTS = [
    (1, "The fire-red map of Ñu."), (2, "the FIRE RED map\nof Ñu"), (3, "The fire‐red mаp of​ Ñu!"), (4, "The fire-red maps of Ñu."), (1, "The fire-red map of Ñu."),
    (10, "Ship: Bakano; Master: Ann; Year: 1866."), (11, "YEAR : 1866 | SHIP : bakano | MASTER : ann"), (12, "Master:Ann\nShip:Bakano\nYear:1866"), (13, "Ship: Ann; Master: Bakano; Year: 1866."), (14, "Ship Bakano Master Ann Year 1866"),
    (20, None), (21, ""), (22, "…"), (23, "—"), (None, "The fire-red map of Ñu."), (30, "Chapter I: The Map"), (31, "CHAPTER I – THE MAP"),
]


def classes(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "id long, en string, key string")
    return {(r.id, r.keep_id, r.copies) for r in collapse(df, Lookalikes.fit(df, "en", usual_first=True), **options).collect()}


WANT = {(1, 1, 3), (2, 1, 3), (3, 1, 3), (4, 4, 1), (10, 10, 4), (11, 10, 4), (12, 10, 4), (14, 10, 4), (13, 13, 1), (30, 30, 2), (31, 30, 2)}


def test_one_row_a_text(spark):
    assert classes(spark, TEXTS) == WANT


def test_hot_keys_take_two_levels_to_the_same_result(spark):
    assert classes(spark, TEXTS, hot=2, salts=3) == WANT
    many = [(i, "Same text" if i % 3 else "same  TEXT!") for i in range(1, 500)]
    assert classes(spark, many, hot=10) == classes(spark, many) == {(i, 1, 499) for i, _ in many}


def test_empty_and_very_long(spark):
    assert classes(spark, []) == set()
    long = "Word " * 40_000
    assert classes(spark, [(5, long), (6, long.upper()), (7, long + "x")]) == {(5, 5, 2), (6, 5, 2), (7, 7, 1)}


def test_colons_in_values_and_long_labels(spark):
    label = "The name under which the ship was entered in the register of the harbour of Bakano"
    rows = [(1, "Time: 10:30; Ratio: 2:1; Ship: Ann"), (2, "Ship: Ann | Time: 10:30 | Ratio: 2:1"), (3, "Ship: Ann | Time: 2:1 | Ratio: 10:30"), (4, f"{label}: Ann; Year: 1866"), (5, f"Year: 1866; {label}: Ann")]
    assert classes(spark, rows) == {(1, 1, 2), (2, 1, 2), (3, 3, 1), (4, 4, 2), (5, 4, 2)}


def test_labels_may_begin_with_a_digit_and_colons_stand_between_digits(spark):
    rows = [(1, "1st: Ann; 2nd: Bo"), (2, "2nd: Bo; 1st: Ann"), (3, "Time: 12:30; Place: Paris"), (4, "Place: Paris; Time: 12:30"), (5, "At 12:30, not at 1:15"), (6, "not at 1:15, At 12:30")]
    assert classes(spark, rows) == {(1, 1, 2), (2, 1, 2), (3, 3, 2), (4, 3, 2), (5, 5, 1), (6, 6, 1)}


def test_classes_are_components_of_both_keys(spark):
    rows = [(1, "a: bc; d: e"), (2, "ab: c; d: e"), (3, "d: e; a: bc"), (4, "d: e; ab: c"), (5, "d e a b c"), (6, "x: y; z: w")]
    assert classes(spark, rows) == {(i, 1, 5) for i in range(1, 6)} | {(6, 6, 1)}
    assert classes(spark, rows, hot=1, salts=3) == classes(spark, rows)


def test_long_chains_of_keys_are_one_component(spark):
    edges = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(60) if i != 40], "a string, b string")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {f"{i:03d}": "000" if i <= 40 else "041" for i in range(61)}
