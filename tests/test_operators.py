"""Matching, mashing, compliance, reshaping, rendering, timing, DDL, streams."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.operators import Field, Rule, Timer, compliance_script, db_creator, definitions, mash, mash_script, match, print_parts, printed_parts, report, select_to_html, select_to_html_colour, string_table_split, string_tables_split, structure_compliance, transpose, transpose_script
from matchloom.operators import compliance, mashing, matching
from matchloom.operators.ddl import Definition, _ordered
from matchloom.operators.compliance import column_errors
from matchloom.operators.numbering import order_by, with_row_number
from matchloom.operators.timer import duration_text
from matchloom.streaming import checked


def test_row_numbers_are_global(spark):
    df = spark.range(1000, numPartitions=7).withColumn("v", (F.col("id") * 37) % 101)
    rows = with_row_number(df, "n", [F.col("v").desc(), F.col("id").asc()]).orderBy("n").collect()
    assert [r.n for r in rows] == list(range(1, 1001))
    assert [(r.v, r.id) for r in rows] == sorted(((r.v, r.id) for r in rows), key=lambda x: (-x[0], x[1]))
    assert with_row_number(df.where("id < 0"), "n", [F.col("id").asc()]).count() == 0


def test_order_text(spark):
    assert [falls for _, falls in order_by("a ASC, coalesce(b, 0) DESC, concat(c, ', ')")] == [False, True, False]


BOOKS = [
    (1, "Ann Lee", "Lee, Ann", "The Grand Tour", 1999), (2, "Ann Lee", "Lee, Ann", "The Grand Tours", None), (3, "Ann Lee", None, "The Grand Tour!", 1999),
    (4, "Ann Lee", "Lee, A", "The Grand Tour", 1999), (5, "Bob", "Bob", "X", 2000), (6, None, None, "X", 2000), (7, "Ann Lée ", "Lee, Ann", "Something else", 1999),
]


def test_match_books(spark):
    df = spark.createDataFrame(BOOKS, "`Book Id` long, Author string, `Author l-f` string, Title string, `Original Publication Year` int")
    rules = "Author,exact,1;Title,levenshtein_low,5;Author l-f,exact,1,a;Original Publication Year,exact,1,a"
    found = match(df, "Book Id", "LEFT(Author, 1)", "coalesce(`Original Publication Year`, 9999) ASC", rules)
    assert found.columns == ["partition", "l_pid", "r_pid", "l_id", "r_id"]
    assert {(r.l_id, r.r_id) for r in found.collect()} == {(1, 3), (1, 2), (3, 2), (3, 4)}
    assert all(r.l_pid < r.r_pid and r.partition == 1 for r in found.collect())
    mashed = match(df, "Book Id", "LEFT(Author, 1)", "coalesce(`Original Publication Year`, 9999) ASC", rules, mash=True)
    assert {(r.l_id, r.r_id) for r in mashed.collect()} == {(1, 3), (1, 2), (1, 4)}


def test_match_with_python_rules(spark):
    df = spark.createDataFrame([(1, "k", "martha"), (2, "k", "marhta"), (3, "k", None), (4, "j", "martha")], "id long, b string, v string")
    pairs = lambda rules: {(r.l_id, r.r_id) for r in match(df, "id", F.col("b"), None, rules).collect()}
    assert pairs("v,osa_low,1") == pairs("v,jaro,0.9") == pairs("v,damerau_levenshtein,1") == {(1, 2)}
    assert pairs("v,osa,1,a") == {(1, 2), (1, 3), (2, 3)}
    assert pairs("v,levenshtein,1") == set()


def test_bad_rules():
    for text in ("v,exact", "v,nothing,1", "v,exact,1,z", "v,exact,x"):
        with pytest.raises((ValueError, ArithmeticError)):
            Rule.parse(text)


def run_mash(spark, rows, source=None):
    frame = lambda x: spark.createDataFrame([(k, *r) for k, r in enumerate(x)], "p long, m string, d string")
    found = mash(frame(rows), frame(source) if source else None, master_key="m", duplicate_key="d", priority="p ASC").collect()
    return {(r.m, r.d) for r in found}


def emulate(rows):
    """The rule, row by row, from a snapshot in each round."""
    now = list(rows)
    for _ in range(50):
        new = []
        for k, (m, d) in enumerate(now):
            new.append(next(((lm, d) for lm, ld in now[:k] if lm != m and ld in (m, d)), (m, d)))
        if new == now:
            return set(now)
        now = new
    raise AssertionError


@pytest.mark.parametrize(
    ("rows", "expected"),
    [
        ([("A", "B"), ("B", "C"), ("C", "D")], {("A", "B"), ("A", "C"), ("A", "D")}),
        ([("A", "C"), ("B", "C")], {("A", "C")}),
        ([("1", "3"), ("2", "3"), ("2", "4"), ("3", "4")], {("1", "3"), ("2", "4")}),
        ([("A", "B"), ("C", "A")], {("A", "B"), ("C", "A")}),
    ],
)
def test_mash(spark, rows, expected):
    assert run_mash(spark, rows) == expected == emulate(rows)


def test_mash_that_never_settles(spark):
    with pytest.raises(RuntimeError):
        run_mash(spark, [("M1", "d"), ("M3", "M1"), ("x", "d")])


def test_mash_like_rule_by_rule(spark):
    rng = random.Random(3)
    for _ in range(3):
        rows = sorted({tuple(sorted(rng.sample("abcdefgh", 2))) for _ in range(10)})
        assert run_mash(spark, rows) == emulate(rows)


def settles(rows):
    try:
        return emulate(rows)
    except AssertionError:
        return None


@pytest.mark.parametrize("small", [0, 1 << 30])
def test_mash_refuses_what_never_settles_and_nothing_else(spark, monkeypatch, small):
    monkeypatch.setattr(mashing, "SMALL", small)
    monkeypatch.setattr(mashing, "PENDING", 3)
    assert {settles(r) is None for r in _ADVERSE} == {True, False}
    for rows in _ADVERSE:
        if (wanted := settles(rows)) is None:
            with pytest.raises(RuntimeError, match="does not settle"):
                run_mash(spark, rows)
        else:
            assert run_mash(spark, rows) == wanted


#: Rows with loops and adverse priorities; some settle and some never do.
_ADVERSE = [[(random.Random(seed * 97 + k).choice("abcdef"), random.Random(seed * 89 + k).choice("abcdef")) for k in range(6)] for seed in range(4)]
_ADVERSE += [[("m2", "m1"), ("m1", "m2"), ("M", "d"), ("m1", "d")], [(f"k{k}", f"k{k + 1}") for k in range(9)]]


def test_mash_rounds_look_at_less_and_less(spark):
    """A chain is rewritten from its start on; later rounds rewrite fewer rows."""
    told = []
    rows = [(k, f"k{k}", f"k{k + 1}") for k in range(9)]
    df = spark.createDataFrame(rows, "p long, m string, d string")
    assert {r.m for r in mash(df, master_key="m", duplicate_key="d", priority="p", on_round=lambda k, n: told.append(n)).collect()} == {"k0"}
    assert told == sorted(told, reverse=True) and told[0] == 8 and told[-1] < 8


def test_mash_with_source_and_nulls(spark):
    assert run_mash(spark, [("A", "B"), ("B", "C")], [("Z", "B")]) == {("A", "B"), ("Z", "B"), ("Z", "C")}
    assert run_mash(spark, [("A", "B"), (None, "B"), ("A", None)]) == {("A", "B"), (None, "B"), ("A", None)}


@pytest.mark.parametrize("rules", ["v,levenshtein_low,2", "v,jaro_winkler,0.9;w,exact,1,a", "w,exact,1;n,exact,1,a", "v,levenshtein,2,a"])
@pytest.mark.parametrize("odd", [False, True])
def test_match_mashes_without_pairs_like_mash(spark, monkeypatch, rules, odd):
    """Classes in parts, chains of several steps, nulls; no pair is formed, and mashing the pairs row by row gives the same rows."""
    monkeypatch.setattr(matching, "PART", 2)
    rng = random.Random(11)
    names = ["anna", "annab", "annabel", "annabell", "bell", "bella", "ella", "Élla", "ella ", None]
    rows = [(k, rng.choice("xy"), rng.choice(names), rng.choice(["p", "q", None]), rng.choice([1, 2, None]), rng.randrange(9)) for k in range(70)]
    df = spark.createDataFrame(rows, "id long, b string, v string, w string, n int, o int").repartition(3)
    with monkeypatch.context() as m:
        m.setattr(matching, "mash_pairs", None)
        found = match(df, "id", F.col("b"), "o DESC", rules, mash=True, source=(lambda c: c % 2 == 1) if odd else None).collect()
    rows = [tuple(r) for r in match(df, "id", F.col("b"), "o DESC", rules).orderBy("l_pid", "l_id", "r_id").collect()]
    now, before, sources = rows, None, [not odd or r[3] % 2 == 1 for r in rows]
    while now != before:
        before, now = now, []
        for k, (p, l_pid, r_pid, l_id, r_id) in enumerate(before):
            taken = next((x for x, rewrites in zip(before[:k], sources) if rewrites and x[3] != l_id and x[4] in (l_id, r_id)), None)
            now.append((p, taken[1], r_pid, taken[3], r_id) if taken else before[k])
    assert sorted(map(tuple, found)) == sorted(set(now)) and len(found) > 20


@pytest.mark.parametrize("rules", ["w,exact,1", "v,levenshtein_low,2", "n,exact,1,a"])
@pytest.mark.parametrize("parts", [2, 32])
def test_match_of_large_classes_in_blocks(spark, monkeypatch, rules, parts):
    """Blocks and parts of every length, null ids and null texts: all pairs once, in order, and mashing from a source like mashing those pairs."""
    for name, value in (("PART", 4), ("PARTS", parts), ("BLOCK", 3), ("SMALL_BLOCK", 2)):
        monkeypatch.setattr(matching, name, value)
    rng = random.Random(5)
    rows = [(k if k % 17 else None, rng.choice("xxy"), rng.choice(["anna", "Ánna", "annab", "bell", None]), rng.choice(["p", "p ", "q", None]), rng.choice([1, 2, None]), k % 7) for k in range(90)]
    df = spark.createDataFrame(rows, "id long, b string, v string, w string, n int, o int").repartition(3)
    ranked = {r: k + 1 for k, r in enumerate(sorted(rows, key=lambda r: (r[5], r[0] is not None, r[0] or 0)))}
    plain = lambda v: v and v.replace("Á", "A").rstrip()
    holds = {
        "w,exact,1": lambda x, y: x[3] is not None and plain(x[3]) == plain(y[3]),
        "v,levenshtein_low,2": lambda x, y: x[2] is not None and y[2] is not None and (x[2] == "bell") == (y[2] == "bell"),
        "n,exact,1,a": lambda x, y: x[4] is None or y[4] is None or x[4] == y[4],
    }[rules]
    # null ids of one priority stand in no fixed order
    want = sorted((x[0], y[0]) for x, p in ranked.items() for y, q in ranked.items() if p < q and x[1] == y[1] and holds(x, y) and None not in (x[0], y[0]))
    found = match(df, "id", F.col("b"), "o ASC", rules).collect()
    assert sorted((r.l_id, r.r_id) for r in found if None not in (r.l_id, r.r_id)) == want and len(want) > 100
    assert all(r.l_pid < r.r_pid for r in found) and len({(r.l_pid, r.r_pid) for r in found}) == len(found)
    df = df.where("id is not null")
    pairs = match(df, "id", F.col("b"), "o ASC", rules)
    odd = F.col("l_id") % 2 == 1
    rounds = mash(pairs.where(~odd), pairs.where(odd), master_key="l_id", duplicate_key="r_id", update_columns=["l_pid"], priority="l_pid ASC, r_pid ASC")
    mashed = match(df, "id", F.col("b"), "o ASC", rules, mash=True, source=lambda c: c % 2 == 1)
    assert sorted((r.l_id, r.r_id) for r in mashed.collect()) == sorted((r.l_id, r.r_id) for r in rounds.collect())


def test_match_of_large_classes_is_dealt_over_tasks_and_small_when_written(spark, monkeypatch, tmp_path):
    """Tasks grow with pairs, and pairs come in runs that take few bytes in a file."""
    monkeypatch.setattr(matching, "PAIRS", 100_000)
    pairs = match(spark.range(1500).withColumn("w", F.lit("p")), "id", F.lit("x"), "id DESC", "w,exact,1")
    assert pairs.rdd.getNumPartitions() >= 11
    monkeypatch.setattr(matching, "PAIRS", 1 << 25)
    match(spark.range(1500).withColumn("w", F.lit("p")), "id", F.lit("x"), "id DESC", "w,exact,1").write.parquet(str(tmp_path / "pairs"))
    files = list((tmp_path / "pairs").glob("*.parquet"))
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == 1500 * 1499 // 2
    assert sum(f.stat().st_size for f in files) < 0.6 * 1500 * 1499 // 2


def test_match_mashes_ids_that_repeat(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (2, "ab"), (3, "abc")], "id long, v string")
    found = match(df, "id", F.lit(1), None, "v,levenshtein,1", mash=True)
    wanted = mash(match(df, "id", F.lit(1), None, "v,levenshtein,1"), master_key="l_id", duplicate_key="r_id", update_columns=["l_pid"], priority="l_pid, r_pid")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))


def test_compliance(spark):
    df = spark.createDataFrame([("1", "abcdef", None), ("x", "ab", "3"), (" 7", None, "12.75")], "a string, b string, c string")
    out = structure_compliance(df, [Field("a", "int"), Field("c", "decimal", 5, 1, nullable=False), Field("b", "varchar", 4), Field("z", "int")])
    head = "Column error: [c] (3) should be in position 2, [b] (2) should be in position 3, [z] is missing from position 4. "
    assert [r["__error__"] for r in out.collect()] == [
        head + "Truncation error: [b] would be truncated when converted to varchar(4). Nullability error: [c] does not contain data. ",
        head + "Datatype error: [a] could not be converted to int. ",
        head + "Truncation error: [a] would be truncated when converted to int. Truncation error: [c] would be truncated when converted to decimal(5, 1). ",
    ]
    assert [r["__error__"] for r in structure_compliance(df, df.schema).collect()] == ["", "", ""]
    assert "Truncation" not in structure_compliance(df, [Field("a", "int"), Field("b", "varchar", 2), Field("c", "varchar", 1)], truncation_check=False).first()["__error__"]
    with pytest.raises(ValueError, match="No structure found to apply."):
        structure_compliance(df, [])


def test_compliance_of_unique_columns(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", "1"), (None, None)], "x string, y string")
    out = structure_compliance(df, [Field("x", "varchar", 5, unique=1), Field("y", "varchar", 5, unique=1)])
    assert sorted((str(r.x), r["__error__"]) for r in out.collect()) == [
        ("None", ""), ("a", "Uniqueness error: ([x], [y]) contains duplicates. "), ("a", "Uniqueness error: ([x], [y]) contains duplicates. "), ("b", "")
    ]


def test_column_errors():
    assert column_errors([Field("a", "int")], ["a", "__x__"]) == ""
    assert column_errors([Field("a", "int"), Field("b", "int")], ["b", "q"]) == "Column error: [a] is missing from position 1, [b] (1) should be in position 2, [q] (2) is spurious. "


def test_compliance_of_a_stream(spark, tmp_path):
    spark.createDataFrame([("1",), ("x",)], "a string").write.parquet(str(tmp_path / "in"))
    stream = checked(spark.readStream.schema("a string").parquet(str(tmp_path / "in")), [Field("a", "int")])
    query = stream.writeStream.format("memory").queryName("checked").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert {(r.a, r["__error__"]) for r in spark.table("checked").collect()} == {("1", ""), ("x", "Datatype error: [a] could not be converted to int. ")}
    with pytest.raises(ValueError):
        checked(stream, [Field("a", "int", unique=1)])


def test_table_split(spark):
    assert string_table_split(spark, "Boss,Location;Massive Moss Charger,Greenpath").collect() == [("Massive Moss Charger", "Greenpath")]
    assert string_table_split(spark, "a|b\nc|d", "|", "\n", header=False).columns == ["Column1", "Column2"]
    assert string_table_split(spark, "a b,c").collect() == []
    with pytest.raises(Exception, match="another number of items"):
        string_table_split(spark, "a,b;c").collect()


def test_transpose(spark):
    rows = [("Sapphira", "Blue", 1), ("Thorn", "Red", None), ("Glaedr", None, 3)]
    df = spark.createDataFrame(rows, "Dragon string, Colour string, n int")
    out = transpose(df)
    assert out.columns == ["Dragon", "Sapphira", "Thorn", "Glaedr"]
    assert [tuple(r) for r in out.collect()] == [("Colour", "Blue", "Red", "NULL"), ("n", "1", "NULL", "3")]
    assert transpose(df, include_labels=False).columns == ["Sapphira", "Thorn", "Glaedr"]
    for bad in (df.unionAll(df), df.select("Dragon")):
        with pytest.raises(ValueError):
            transpose(bad)


def test_html(spark):
    out = select_to_html(spark.createDataFrame([("value",)], "column string")).first()[0]
    assert out == (
        '<table style="font-size:.9em;font-family:Verdana,Sans-Serif;border:3px solid;border-collapse:collapse">\n\t<tr>\n\t\t<th style="border:2px solid;text-align:center">column</th>\n\t</tr>\n'
        '\t<tr>\n\t\t<td style="border:2px solid;text-align:left">value</td>\n\t</tr>\n</table>'
    )
    df = spark.createDataFrame([(1, None), (None, "b")], "a int, b string")
    assert ">0</td>" in select_to_html(df).first()[0] and 'left"></td>' in select_to_html(df).first()[0]
    assert select_to_html(df.where("a > 9")).first()[0] is None


def test_html_colour(spark):
    df = spark.createDataFrame([("x", -2, "p\nq"), ("y", 4, None), ("z", 0, "r")], "k string, n int, t string")
    out = select_to_html_colour(df, "k DESC", sum=True).first()[0]
    cells = [line.strip() for line in out.split("\n") if "<td" in line]
    assert [c[c.index(">") + 1 : -5] for c in cells] == ["z", "0", "r", "y", "4", "", "x", "-2", "pq", "Total", "2", ""]
    assert "background-color:#8C8C1B;color:#ffffff;text-align:right" in cells[1]
    assert "background-color:#1B8C1B" in cells[4] and "background-color:#8C1B1B" in cells[7]
    assert "background-color:#ffffff;color:#000000;text-align:center" in cells[2] and "#cfcfcf" in cells[5]
    assert "background-color:#1b8c1b;color:#ffffff;text-align:right;font-style:italic" in cells[10]


def test_timer(spark):
    timer = Timer(spark)
    assert timer.display().first()[0] == "No timer data has been recorded."
    assert timer("load").startswith("load (Instance 1) - 00:00:0")
    timer()
    timer.begin("select 2")
    timer("load")
    rows = timer.display().orderBy("instance_id").collect()
    assert [r.process_instance for r in rows] == [1, 2, 1]
    assert rows[0].task_end == rows[1].instance_end and rows[1].instance_start == rows[0].instance_end
    assert rows[0].process_max >= rows[0].process_avg >= rows[0].process_min
    assert duration_text(3_723_004) == "01:02:03.004"


def test_print_parts():
    text = "a" * 10 + "\r" + "b" * 10 + "\nc"
    assert list(print_parts(text, 15)) == ["a" * 10, "b" * 10, "c"] or list(print_parts(text, 15))[0] == "a" * 10
    assert "".join(print_parts("x" * 9001)) == "x" * 9001
    assert list(print_parts("")) == []


def test_ddl(spark):
    spark.sql("CREATE SCHEMA IF NOT EXISTS made")
    spark.createDataFrame([(1, "it's", None), (2, None, 2.5)], "id int, `a b` string, v double").write.saveAsTable("made.t")
    spark.sql("CREATE TABLE made.none (x int) USING parquet")
    spark.range(1001).write.saveAsTable("made.many")
    spark.sql("CREATE VIEW made.w AS SELECT id FROM made.t")
    before = spark.table("made.t").orderBy("id").collect()
    kinds = [d.kind for d in definitions(spark, ["made"], data=True)]
    assert kinds == ["SC", "U", "U", "U", "DT", "DT", "DT", "V"]
    script = db_creator(spark, ["made"], replace=True, data=True)
    assert "/* Source table is empty. */" in script and "/* Source table has more than 1000 rows. */" in script
    assert script.index("DROP VIEW") < script.index("DROP TABLE") < script.index("CREATE SCHEMA") < script.index("INSERT INTO") < script.index("CREATE OR REPLACE VIEW")
    db_creator(spark, ["made"], replace=True, data=True, commit=True)
    assert spark.table("made.t").orderBy("id").collect() == before and spark.table("made.w").count() == 2
    assert spark.table("made.t").schema["a b"].dataType == T.StringType()
    spark.sql("DROP SCHEMA made CASCADE")


def test_scripts_in_the_order_of_what_is_read(spark):
    """Made again on an empty catalog: views of later views, functions that read tables and views, names without their schema."""
    spark.sql("CREATE SCHEMA made2")
    try:
        spark.sql("CREATE TABLE made2.t USING parquet AS SELECT 1 AS id UNION ALL SELECT 2")
        spark.sql("USE made2")
        spark.sql("CREATE VIEW z AS SELECT id FROM t WHERE EXISTS (SELECT 1 FROM t AS u WHERE u.id > t.id)")
        spark.sql("USE default")
        spark.sql("CREATE FUNCTION made2.f(n INT) RETURNS BIGINT RETURN (SELECT count(*) FROM made2.z WHERE id >= n)")
        spark.sql("CREATE VIEW made2.a AS WITH c AS (SELECT * FROM made2.z) SELECT id, made2.f(1) AS n FROM c")
        script, again = db_creator(spark, ["made2"], data=True), db_creator(spark, ["made2"], replace=True, data=True)
        assert [d.name for d in definitions(spark, ["made2"])] == [None, "t", "z", "f", "a"]
        spark.sql("DROP FUNCTION made2.f")  # the session would remember it
        spark.sql("DROP SCHEMA made2 CASCADE")
        for statement in script.split(";\n"):
            if statement.strip():
                spark.sql(statement)
        assert [tuple(r) for r in spark.sql("SELECT * FROM made2.a").collect()] == [(1, 1)] and spark.catalog.currentDatabase() == "default"
        assert again.index("DROP VIEW IF EXISTS `made2`.`a`") < again.index("DROP FUNCTION IF EXISTS `made2`.`f`") < again.index("DROP VIEW IF EXISTS `made2`.`z`") < again.index("DROP TABLE")
        db_creator(spark, ["made2"], replace=True, data=True, commit=True)
        assert spark.table("made2.a").count() == 1
    finally:
        spark.sql("USE default")
        spark.sql("DROP SCHEMA IF EXISTS made2 CASCADE")


def test_circles_are_named():
    made = [Definition("V", "s", "a", "", None, (("s", "b"),)), Definition("FN", "s", "b", "", None, (("s", "c"),)), Definition("V", "s", "c", "", None, (("s", "b"), ("s", "t"))), Definition("U", "s", "t", "")]
    with pytest.raises(ValueError, match="circle: `s`.`b`, `s`.`c`"):
        _ordered(made)
    assert [d.name for d in _ordered(made[::-1][:1] + [made[0]])] == ["t", "a"]


def test_string_tables(spark):
    rows = spark.createDataFrame([(1, "a,b;1,2;,x"), (2, "a,b"), (3, None)], "k int, s string")
    assert sorted(map(tuple, string_tables_split(rows, "s", ["a", "b"]).collect())) == [(1, 1, "1", "2"), (1, 2, "", "x")]
    assert sorted(map(tuple, string_tables_split(rows.where("k = 2"), "s", ["x", "y"], header=False).collect())) == [(2, 1, "a", "b")]
    with pytest.raises(Exception, match="other names"):
        string_tables_split(rows, "s", ["a", "c"]).collect()
    for names in (["k", "b"], ["a", "a"], ["line"]):
        with pytest.raises(ValueError):
            string_tables_split(rows, "s", names)


def test_report_of_one_large_task(spark):
    """Numbers in a task are made by ranges: no partition holds the task as a whole."""
    log = spark.range(4000).selectExpr(
        "if(id % 4 = 0, NULL, 's') AS session_id", "'p' AS process", "id AS instance_id", "timestamp_ntz'2024-01-01' AS task_start", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id % 7) AS instance_start",
        "timestamp_ntz'2024-01-02' AS instance_end", "'b' AS batch_id", "'q' AS plan_id",
    )
    out = report(log)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.session_id, r.instance_id): r.process_instance for r in out.collect()}
    for session, ids in ((None, [k for k in range(4000) if k % 4 == 0]), ("s", [k for k in range(4000) if k % 4])):
        assert [got[session, k] for k in sorted(ids, key=lambda k: (k % 7, k))] == list(range(1, len(ids) + 1))


@pytest.mark.parametrize("limit", [compliance.BROADCAST_BYTES, -1])
def test_rows_without_repeats_do_not_move(spark, monkeypatch, limit):
    monkeypatch.setattr(compliance, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(compliance, "HOT", 4)
    rows = [(k, f"u{k}", None if k % 2 else "n") for k in range(3000)] + [(k, "hot", "n") for k in range(800)] + [(k, f"d{k % 40}", None) for k in range(120)] + [(1, None, None), (2, None, None), (3, None, "n")]
    df = spark.createDataFrame(rows, "k long, x string, y string").repartition(3)
    out = structure_compliance(df, [Field("k", "bigint"), Field("x", "varchar", 9, unique=1), Field("y", "varchar", 9, unique=1)])
    got = [(r.k, r.x, r.y, "Uniqueness" in r["__error__"]) for r in out.collect()]
    counts = Counter((x, y) for _, x, y in rows)
    assert sorted(got, key=repr) == sorted(((*r, counts[r[1:]] > 1) for r in rows), key=repr)
    twice = df.groupBy(F.col("x").alias("__u0"), F.col("y").alias("__u1")).count().where("count > 1")
    asked = compliance.may_repeat(df, twice, [F.col("x"), F.col("y")], [F.col("__u0"), F.col("__u1")], "may").where("may")
    assert 800 + 120 + 2 <= asked.count() <= 800 + 120 + 2 + 20  # of 3,923 rows; the rest only by chance


def test_nothing_is_joined_where_nothing_repeats(spark):
    out = structure_compliance(spark.range(100).selectExpr("cast(id as string) AS a"), [Field("a", "varchar", 5, unique=1)])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and {r["__error__"] for r in out.collect()} == {""}


def test_one_plan_of_two_batches(spark):
    timer = Timer(spark)
    for text in ("SELECT id FROM range(9) WHERE id > 3", "select  id  from range(9)\nwhere id > 3", "SELECT id FROM range(9) WHERE id > 4"):
        timer.begin(text, spark.sql(text))
        timer("step")
    plans, batches = ([r[k] for r in timer.rows] for k in (7, 6))
    assert plans[0] == plans[1] != plans[2] and len(set(batches)) == 3
    timer.begin("no query")
    timer("step")
    assert timer.rows[-1][6] == timer.rows[-1][7] and timer.display().count() == 4


@pytest.mark.parametrize("most", [1, 5, 4000])
def test_printed_parts_like_one_by_one(spark, most):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab \n\r\u00e9\U0001f600") for _ in range(rng.randint(0, 40))) for _ in range(200)] + ["", " ", "\n", "x" * 9000, "x\n" * 5000, "y" * 4000 + "\nz", " " * 9000, "a" + " " * 9000, None]
    out = spark.createDataFrame(list(enumerate(texts)), "k int, s string").select("k", printed_parts("s", most).alias("p"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        assert r.p == (None if texts[r.k] is None else list(print_parts(texts[r.k], most))), repr(texts[r.k])[:60]


def test_the_printed_script_of_mash(spark):
    """Run as SQL, the script leaves what the operator returns."""
    rng = random.Random(12)
    rows = [(m, d, k) for k, (m, d) in enumerate(sorted({tuple(sorted(rng.sample("abcdefgh", 2))) for _ in range(12)}))] + [(None, "a", 25), ("b", None, 26)]
    assert settles([r[:2] for r in rows[:-2]])
    df = spark.createDataFrame(rows, "`m k` string, d string, v int")
    with_row_number(df, "p", [F.col("v").asc()]).write.mode("overwrite").saveAsTable("to_mash")
    try:
        script = mash_script("to_mash", "default.mashed", master_key="m k", duplicate_key="d", priority="p", update_columns=["v"])
        assert script.startswith("BEGIN") and "WHILE" in script
        spark.sql(script)
        wanted = mash(df, master_key="m k", duplicate_key="d", priority="v", update_columns=["v"])
        assert sorted(map(tuple, spark.table("mashed").select("m k", "d", "v").collect()), key=repr) == sorted(map(tuple, wanted.select("m k", "d", "v").collect()), key=repr)
        assert {t.name for t in spark.catalog.listTables("default") if "mashed" in t.name} == {"mashed"}
    finally:
        for name in ("to_mash", "mashed"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_transpose_as_a_script(spark):
    rows = [("Thorn", 1, None), ("it's \\ `odd`", 2, "x"), (None, 3, "it's")]
    df = spark.createDataFrame(rows, "`the name` string, age int, `o'c` string")
    df.write.mode("overwrite").saveAsTable("to_turn")
    try:
        for labels in (True, False):
            spark.sql(transpose_script("to_turn", df.columns, "default.turned", labels))
            found, wanted = spark.table("turned"), transpose(df, labels)
            assert sorted(found.columns) == sorted(wanted.columns)
            assert sorted(found.select(*(F.col("`" + c.replace("`", "``") + "`") for c in sorted(found.columns))).collect()) == sorted(tuple(r[c] for c in sorted(found.columns)) for r in wanted_rows(wanted))
        df.union(df).write.mode("overwrite").saveAsTable("to_turn_twice")
        with pytest.raises(Exception, match="repeat"):
            spark.sql(transpose_script("to_turn_twice", df.columns, "default.turned"))
        assert spark.table("turned").count() == 2  # what was there stays
        with pytest.raises(ValueError):
            transpose_script("to_turn", ["a"], "b")
    finally:
        for name in ("to_turn", "to_turn_twice", "turned"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def wanted_rows(df):
    return [dict(zip(df.columns, r)) for r in df.collect()]


def test_compliance_as_a_script(spark):
    rows = [("1", "abc", "2020-01-01", "x"), ("1", "abcd ", "no", None), ("x", "ab", None, "y"), (None, None, "2021-02-03", "x"), (None, "abcde", "", "y'")]
    df = spark.createDataFrame(rows, "`the id` string, code string, day string, more string")
    fields = [Field("the id", "int", nullable=False, unique=1), Field("day", "date", datestyle="it's"), Field("code", "varchar", 3, unique=2), Field("more", "char", 1, nullable=False, unique=2), Field("sum", "decimal", 9, 2)]
    df.write.mode("overwrite").saveAsTable("to_check")
    try:
        for truncation in (True, False):
            script = compliance_script("to_check", df.columns, fields, "default.was_checked", truncation)
            spark.sql(script)
            wanted = structure_compliance(df, fields, truncation)
            assert spark.table("was_checked").columns == wanted.columns
            assert sorted(map(tuple, spark.table("was_checked").collect()), key=repr) == sorted(map(tuple, wanted.collect()), key=repr)
        assert "Uniqueness" in script and spark.table("was_checked").where("`__error__` like '%contains duplicates%'").count() == 4
        with pytest.raises(ValueError):
            compliance_script("to_check", df.columns, [], "b")
    finally:
        for name in ("to_check", "was_checked"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
