from pyspark.sql import functions as F

from tabscope.operators.clean import rename
from tabscope.scratch import materialize, new_path
from tabscope.sources import read_csv, read_documents, read_named_columns, read_pipe, read_tsv, write_table
from tabscope.sources import schemas as S


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_credit_csv_is_read_by_header_name(spark, tmp_path):
    # another column order than the schema's, a missing value in each spelling, an extra column
    text = "ID,age,rev_util,late_30_59,debt_ratio,monthly_inc,open_credit,late_90,real_estate,late_60_89,dependents,dlq_2yr\n" \
           "1,30,0.5,0,NaN,1000.5,3,0,1,2,,0\n2,45,1.2,1,0.3,NA,4,1,0,0,2,1\n"
    df = rename(read_csv(spark, write(tmp_path / "c.csv", text), S.CREDIT), S.CREDIT_RENAMES)
    rows = df.orderBy("edad").collect()
    assert [r["edad"] for r in rows] == [30, 45]
    assert rows[0]["radio_deuda"] is None and rows[0]["num_dependientes"] is None
    assert rows[1]["ingreso_mensual"] is None and rows[1]["uso_de_credito"] == 1.2
    assert dict(df.dtypes)["cuentas_abiertas"] == "int" and "ID" not in df.columns


def test_csv_types_are_inferred_without_a_schema(spark, tmp_path):
    df = read_csv(spark, write(tmp_path / "i.csv", "a,b,c\n1,x,1.5\n2,\"y, \"\"z\"\"\",NaN\n"))
    assert dict(df.dtypes) == {"a": "int", "b": "string", "c": "double"}
    assert [(r.b, r.c) for r in df.orderBy("a").collect()] == [("x", 1.5), ('y, "z"', None)]


def test_plain_files_are_split_and_quoted_breaks_are_kept(spark, tmp_path):
    lines = "a,b\n" + "".join(f'{i},"x ""{i}"" y"\n' for i in range(3000))
    plain, broken = write(tmp_path / "plain.csv", lines), write(tmp_path / "broken.csv", lines + '7,"one\ntwo ""three\nfour"" ,five"\n8,z\n')
    returns = write(tmp_path / "returns.csv", lines.replace("\n", "\r\n"))
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        parts = {path: read_csv(spark, path).rdd.getNumPartitions() for path in (plain, broken, returns)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert parts[plain] > 3 and parts[returns] > 3 and parts[broken] == 1
    for path in (plain, broken, returns):
        assert sorted(map(tuple, read_csv(spark, path).collect())) == sorted(map(tuple, read_csv(spark, path, multi_line=True).collect()))
    assert {r.b for r in read_csv(spark, broken).filter("a in (7, 8)").collect()} == {'x "7" y', 'x "8" y', 'one\ntwo "three\nfour" ,five', "z"}


def test_ratings_without_header(spark, tmp_path):
    df = read_tsv(spark, write(tmp_path / "r.tsv", "1\t10\t3\t881250949\n2\t11\t\t891717742\n"), S.RATINGS)
    assert [tuple(r) for r in df.orderBy("userid").collect()] == [(1, 10, 3, 881250949), (2, 11, None, 891717742)]


def test_users_keep_their_zip_codes_as_text(spark, tmp_path):
    df = read_pipe(spark, write(tmp_path / "u.txt", "userid|age|gender|occupation|zcode\n1|24|M|technician|05711\n2|53|F|other|T8H1N\n"), S.USERS)
    assert [r.zcode for r in df.orderBy("userid").collect()] == ["05711", "T8H1N"]


def test_movies_latin1_with_and_without_header(spark, tmp_path):
    flags = "|".join("0" for _ in range(19))
    line = f"1|Les Misérables (1995)|01-Jan-1995||http://x|{flags}\n"
    plain = write(tmp_path / "plain.item", line, "latin-1")
    titles = read_named_columns(spark, plain, S.MOVIES, ["movie_title"])
    assert titles.columns == ["movie_title"] and titles.first()[0] == "Les Misérables (1995)"
    headed = write(tmp_path / "headed.item", "|".join(S.MOVIE_COLUMNS) + "\n" + line, "latin-1")
    row = read_pipe(spark, headed, S.MOVIES, encoding="ISO-8859-1").first()
    assert row["movie_title"] == "Les Misérables (1995)" and row["Sci-Fi"] == 0 and row["video_release_date"] is None


def test_documents_whole_file_and_by_separator(spark, tmp_path):
    write(tmp_path / "a.txt", "one\ntwo\n")
    assert [r.text for r in read_documents(spark, str(tmp_path / "a.txt")).collect()] == ["one\ntwo\n"]
    many = write(tmp_path / "b.txt", "one\ntwo\x1ethree\n\nfour")
    assert sorted(r.text for r in read_documents(spark, many, "\x1e").collect()) == ["one\ntwo", "three\n\nfour"]


def test_sink_and_written_table(spark, tmp_path):
    df = spark.range(5).withColumn("k", F.col("id") % 2)
    path = write_table(df, str(tmp_path / "out"), partition_by=["k"])
    assert spark.read.parquet(path).count() == 5
    again = materialize(df, "t")
    assert sorted(again.collect()) == sorted(df.collect()) and new_path(spark, "a") != new_path(spark, "a")


def test_quoted_line_breaks_stay_in_their_value(spark, tmp_path):
    path = write(tmp_path / "m.csv", 'a,b\n1,"x\ny"\n2,"z ""q""\n\nw"\n')
    assert sorted(tuple(r) for r in read_csv(spark, path).collect()) == [(1, "x\ny"), (2, 'z "q"\n\nw')]
    split = read_csv(spark, write(tmp_path / "n.csv", "a,b\n1,x\n2,y\n"), multi_line=False)
    assert sorted(tuple(r) for r in split.collect()) == [(1, "x"), (2, "y")]


def test_missing_spellings(spark, tmp_path):
    df = read_csv(spark, write(tmp_path / "x.csv", "n,t,z\n1,NA,true\nN/A,u,null\nnull,None,\n2.5,NaN,false\n"))
    assert dict(df.dtypes) == {"n": "double", "t": "string", "z": "boolean"}
    assert [tuple(r) for r in df.collect()] == [(1.0, None, True), (None, "u", None), (None, None, None), (2.5, None, False)]
    kept = read_csv(spark, str(tmp_path / "x.csv"), missing=("",)).first()
    assert kept["t"] == "NA" and kept["n"] == "1"
