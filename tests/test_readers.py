import csv

import pytest

from cohortlens.sources import readers


def test_quoted_line_breaks_in_split_files(spark, tmp_path):
    rows = [(str(i), f'a{i}\nb "{i}"\n\n,c' if i % 3 == 0 else ("x" * (i % 40)), "" if i % 5 else " ä\r\nb ") for i in range(900)]
    other = [("p", "second\nline", "901"), ("q", "", "902")]
    with open(tmp_path / "one.csv", "w", newline="", encoding="utf-8") as f:
        f.write("﻿")
        csv.writer(f).writerows([("id", "text", "note"), *rows])
    with open(tmp_path / "two.csv", "w", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows([("extra", "text", "id"), *other])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1777")
    try:
        got = readers.read_strings(spark, [str(tmp_path / "one.csv"), str(tmp_path / "two.csv")])
        found = {(r["id"], r["text"], r["note"], r["extra"]) for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    tidy = lambda x: x.replace("\r\n", "\n")
    assert {tuple(tidy(c) for c in r) for r in found} == {(*map(tidy, r), "") for r in rows} | {(i, t, "", e) for e, t, i in other}
    assert got.count() == 902


def test_latin_and_semicolons(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('id;name\r\n1;"citt\xe0;\nnuova"\r\n\r\n2;b\r\n'.encode("latin-1"))
    got = readers.read_dialect_csv(spark, str(tmp_path / "a.csv"))
    assert sorted(tuple(r) for r in got.collect()) == [("1", "città;\nnuova"), ("2", "b")]


def test_nothing_to_read(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ValueError):
        readers.read_strings(spark, str(tmp_path / "empty.csv"))


def test_plain_files_are_read_without_a_shuffle(spark, tmp_path):
    """Headers repeated as records, a byte order mark, a file of a header alone, more pieces than files."""
    rows = [(str(i), "x" * (i % 50) if i % 4 else f'a, "{i}"') for i in range(700)]
    for name, part in (("one", rows[:500]), ("two", rows[500:]), ("three", [])):
        with open(tmp_path / f"{name}.csv", "w", newline="", encoding="utf-8") as f:
            csv.writer(f, lineterminator="\n").writerows([("id", "text"), *part, *([("id", "text")] * 2 if part else [])])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1777")
    try:
        got = readers.read_strings(spark, str(tmp_path))
        plan = got._jdf.queryExecution().toString()
        found = [tuple(r) for r in got.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(found) == sorted([*rows, *[("id", "text")] * 4])
    assert "Window" not in plain_part(plan) and "Exchange" not in plain_part(plan) and "Join" not in plain_part(plan)


def plain_part(plan):
    return plan[plan.index("== Physical Plan =="):]


def test_plain_and_broken_files_with_several_headers(spark, tmp_path):
    texts = {"a": "﻿id,text\r\n1,x\r\nid,text\r\n", "b": "text,id\ny,2\n", "c": 'id,text\n3,"two\nlines"\nid,text\n', "d": "id,text\n4,z"}
    for name, content in texts.items():
        (tmp_path / f"{name}.csv").write_bytes(content.encode())
    got = readers.read_strings(spark, str(tmp_path)).select("id", "text")
    assert sorted(tuple(r) for r in got.collect()) == [("1", "x"), ("2", "y"), ("3", "two\nlines"), ("4", "z"), ("id", "text"), ("id", "text")]
