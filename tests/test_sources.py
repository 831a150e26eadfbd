from __future__ import annotations

import pytest

from plumbline import export_csv, read_csv, read_table
from plumbline.rules import NULL_TOKENS
from plumbline.sources.staging import staging_folder


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_types_and_null_tokens(spark, tmp_path):
    tokens = "".join(f"{t if t else '\"\"'},1\n" for t in NULL_TOKENS)
    text = "a,b\n" + tokens + "5,2\n"
    df = read_csv(spark, write(tmp_path / "t.csv", text))
    assert dict(df.dtypes) == {"a": "bigint", "b": "bigint"}
    assert df.where("a is null").count() == len(NULL_TOKENS)


def test_inference(spark, tmp_path):
    df = read_csv(spark, write(tmp_path / "t.csv", "i,f,b,s,d,e\n1,1.5,True,x,2024-01-01,\n2,1e3,False,1d,2024-01-02,\n"))
    assert dict(df.dtypes) == {"i": "bigint", "f": "double", "b": "boolean", "s": "string", "d": "string", "e": "double"}


def test_latin1_fallback_and_bom(spark, tmp_path):
    latin = read_csv(spark, write(tmp_path / "l.csv", "name\ncafé\n", "latin-1"))
    assert latin.first()[0] == "café"
    assert read_csv(spark, write(tmp_path / "b.csv", "﻿name\nx\n")).columns == ["name"]


def test_short_rows_are_filled_and_long_rows_rejected(spark, tmp_path):
    assert read_csv(spark, write(tmp_path / "s.csv", "a,b\n1,2\n3\n")).where("b is null").count() == 1
    with pytest.raises(ValueError, match="more fields"):
        read_csv(spark, write(tmp_path / "x.csv", "a,b\n1,2,3\n"))


@pytest.mark.parametrize("name, text", [("empty.csv", ""), ("head.csv", "a,b\n")])
def test_empty_files_are_rejected(spark, tmp_path, name, text):
    with pytest.raises(ValueError):
        read_table(spark, write(tmp_path / name, text))


def test_unknown_format_is_rejected(spark):
    with pytest.raises(ValueError, match="unsupported"):
        read_table(spark, "/tmp/table.xyz")


def test_line_breaks_inside_quotes(spark, tmp_path):
    text = 'a,b\n1,"line one\nline two"\n2,plain\n3,"say ""x""\n\nend"\n'
    expected = [(1, "line one\nline two"), (2, "plain"), (3, 'say "x"\n\nend')]
    assert sorted(map(tuple, read_table(spark, write(tmp_path / "m.csv", text)).collect())) == expected


def test_valid_replacement_character_stays_utf8(spark, tmp_path):
    df = read_csv(spark, write(tmp_path / "u.csv", "a\ncafé\n\ufffd\n"))
    assert sorted(r.a for r in df.collect()) == ["café", "\ufffd"]


def test_export_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, ' say "hi", ok '), (2, None)], "n bigint, s string")
    path = export_csv(df, str(tmp_path), "table.csv")
    assert path.endswith("/table_cleaned.csv")
    assert sorted(map(tuple, read_table(spark, path).collect())) == [(1, ' say "hi", ok '), (2, None)]


class _Unset:
    """A session whose settings name no staging folder."""

    def __init__(self, master):
        self.sparkContext, self.conf, self.master = self, self, master

    def getConf(self):
        return self

    def get(self, _name, default=None):
        return default


def test_staging_folder_is_required_on_a_cluster():
    assert staging_folder(_Unset("local[2]")) == staging_folder(_Unset("local[2]"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging_folder(_Unset("spark://host"))


def test_staging_folder_follows_the_session(spark):
    assert staging_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
