"""Mapping files of all formats, and the way back."""

import pytest
from pyspark.sql import functions as F

from symtransfer.sinks.tiny import write_tiny
from symtransfer.sources import mappings
from symtransfer.sources.mappings import read_mapping


def parsed(spark, tmp_path, text, **options):
    path = tmp_path / "m.txt"
    path.write_text(text, encoding="utf-8")
    m = read_mapping(spark, str(path), **options)
    classes = [(r.from_name, r.to_name) for r in m.classes.orderBy("ord").collect()]
    members = [(r.from_class, r.kind, r.from_name, r.desc, r.to_name) for r in m.members.orderBy("ord").collect()]
    return m, classes, members


def test_tiny_v2(spark, tmp_path):
    m, classes, members = parsed(spark, tmp_path, "tiny\t2\t0\tofficial\tnamed\nc\ta\tp/Foo\n\tm\tx\t()V\trun\n\tf\ty\tI\tcount\n\tf\ts\t[Ljava/lang/String;\targs\n\tm\tq\tplain\nc\tb\tp/Bar\n\tf\tz\tfield\n\t\tc\tcomment\n")
    assert (m.format, m.namespaces) == ("tiny-v2", ("official", "named"))
    assert classes == [("a", "p/Foo"), ("b", "p/Bar")]
    assert members == [("a", "m", "x", "()V", "run"), ("a", "f", "y", "I", "count"), ("a", "f", "s", "[Ljava/lang/String;", "args"), ("a", "m", "q", "()V", "plain"), ("b", "f", "z", "I", "field")]


def test_tiny_v1(spark, tmp_path):
    m, classes, members = parsed(spark, tmp_path, "tiny\t1\tobf\tnew\na\tp/Foo\n\tx\trun\t(I)V\n\ty\tcount\tI\n\tz\tlast\n")
    assert (m.format, m.namespaces, classes) == ("tiny-v1", ("obf", "new"), [("a", "p/Foo")])
    assert members == [("a", "m", "x", "(I)V", "run"), ("a", "f", "y", "I", "count"), ("a", "m", "z", "()V", "last")]


def test_tsrg_v2(spark, tmp_path):
    text = "tsrg2\t2\tleft\tright\na\tp/Foo\n\tm\tx\t0\trun\t()V\n\tm\tw\t0\twalk\n\tf\ty\tcount\tI\n\tv\tvalue\n\tu\tuse\t(J)V\n\tt\t[I\ttake\nc\tb\tp/Bar\n\tf\tz\tzed\n"
    m, classes, members = parsed(spark, tmp_path, text)
    assert (m.format, m.namespaces, classes) == ("tsrg-v2", ("left", "right"), [("a", "p/Foo"), ("b", "p/Bar")])
    assert members == [("a", "m", "x", "()V", "run"), ("a", "m", "w", "()V", "walk"), ("a", "f", "y", "I", "count"), ("a", "f", "v", "I", "value"), ("a", "m", "u", "(J)V", "use"), ("a", "f", "t", "[I", "take"), ("b", "f", "z", "I", "zed")]


def test_tsrg_v1(spark, tmp_path):
    m, classes, members = parsed(spark, tmp_path, "a\tp/Foo\n\tx\trun\t()V\n\ty\tcount\tI\n\tz\tlast\n")
    assert (m.format, classes) == ("tsrg-v1", [("a", "p/Foo")])
    assert members == [("a", "m", "x", "()V", "run"), ("a", "f", "y", "I", "count"), ("a", "m", "z", "()V", "last")]


def test_srg(spark, tmp_path):
    m, classes, members = parsed(spark, tmp_path, "# note\nPK: . net\nCL: a p/Foo\n  MD: a/x (I)V p/Foo/run (I)V\nFD: a/y p/Foo/count\nFD: o/q/z k/Late/zed\n".replace("PK: . net\n", ""))
    assert (m.format, classes) == ("srg", [("a", "p/Foo"), ("o/q", "k/Late")])
    assert members == [("a", "m", "x", "(I)V", "run"), ("a", "f", "y", "I", "count"), ("o/q", "f", "z", "I", "zed")]


def test_a_later_class_row_replaces_the_class(spark, tmp_path):
    _, classes, members = parsed(spark, tmp_path, "MD: a/x ()V p/Old/run ()V\nCL: b p/B\nCL: a p/New\nFD: a/y p/New/one\nFD: a/y p/New/two\n")
    assert classes == [("a", "p/New"), ("b", "p/B")]
    assert members == [("a", "f", "y", "I", "two")]


def test_arrows(spark, tmp_path):
    text = (
        "# mapping file\r\np.q.Name -> a:\r\n    int count -> b\r\n    1:3:void run(int) -> c\r\n    7:java.lang.String text(byte[],java.util.Map<K,V>) -> d\r\n"
        "p.q.Name$Inner -> ab:\r\n    p.q.Name$Inner[] all -> e\r\np.q.Name$Inner$Deep -> a$ab$x:\r\n    boolean on() -> f\r\np.Other -> z:\r\n    nonsense\r\n    long l -> g\r\n"
    )
    m, classes, members = parsed(spark, tmp_path, text)
    assert m.format == "mojang"
    assert classes == [("a", "p/q/Name"), ("ab", "p/q/Name$Inner"), ("ab$a$ab$x", "p/q/Name$Inner$Deep"), ("z", "p/Other")]
    assert members[:3] == [("a", "f", "b", "I", "count"), ("a", "m", "c", "(I)V", "run"), ("a", "m", "d", "([BLjava/util/Map;)Ljava/lang/String;", "text")]
    assert members[3:] == [("ab", "f", "e", "[Lp/q/Name$Inner;", "all"), ("ab$a$ab$x", "m", "f", "()Z", "on"), ("z", "f", "g", "J", "l")]


def test_inner_names_are_appended_to_their_outer(spark, tmp_path):
    _, classes, _ = parsed(spark, tmp_path, "p.Foo -> aaa:\np.Foo$Bar -> x.y.b:\np.Foo$Baz -> c:\n")
    assert classes == [("aaa", "p/Foo"), ("aaa$b", "p/Foo$Bar"), ("aaa$c", "p/Foo$Baz")]


def test_unknown_and_broken_files(spark, tmp_path):
    with pytest.raises(ValueError, match="could not auto-detect"):
        parsed(spark, tmp_path, "just some words\nand more\n")
    with pytest.raises(ValueError, match="without a name"):
        parsed(spark, tmp_path, "tiny\t2\t0\ta\tb\nc\ta\tb\n\tm\t\t()V\tx\n")


def test_a_reader_that_fails_leaves_the_file_to_the_next(spark, tmp_path):
    # the first line looks like TSRG v1, whose reader rejects the nameless member; the third like arrows
    text = "p.Foo\tx\n\t\ty\t()V\np.Foo -> a:\n    int count -> b\n"
    m, classes, members = parsed(spark, tmp_path, text)
    assert m.format == "mojang" and classes == [("a", "p/Foo")] and members == [("a", "f", "b", "I", "count")]
    with pytest.raises(ValueError, match="without a name"):
        parsed(spark, tmp_path, text, format="tsrg-v1")


def test_readers_can_be_registered(spark, tmp_path):
    def rows(spark, path, lines, nested):
        cut = F.split("line", "=")
        none = F.lit(None).cast("string")
        return lines.where("line LIKE '%=%'").select("ord", F.lit("c").alias("kind"), none.alias("owner"), none.alias("owner_to"), cut[0].alias("name"), none.alias("desc"), cut[1].alias("to"))

    mappings.register(mappings.Reader("pairs", "Pairs", lambda head: F.get(head, F.lit(0)) == "pairs", rows))
    try:
        m, classes, members = parsed(spark, tmp_path, "pairs\na=p/Foo\nb=p/Bar\n")
        assert (m.format, classes, members) == ("pairs", [("a", "p/Foo"), ("b", "p/Bar")], [])
    finally:
        mappings.unregister("pairs")
    assert [r.format for r in mappings.readers()] == list(mappings.FORMATS)
    with pytest.raises(ValueError, match="could not auto-detect"):
        parsed(spark, tmp_path, "pairs\na=p/Foo\n")


def test_written_files_read_the_same(spark, tmp_path):
    text = "tiny\t2\t0\tobfuscated\tnamed\nc\taaa\tp/Foo\n\tm\tx\t()V\trun\n\tm\ta\t(I)V\tgo\n\tf\ty\tI\tcount\nc\tbbb\tbbb\n\tf\tz\tJ\tzed\n"
    m, *first = parsed(spark, tmp_path, text)
    out = tmp_path / "deep" / "out.tiny"
    assert write_tiny(m.classes, m.members, str(out), m.namespaces) == {"classes": 2, "methods": 2, "fields": 2}
    assert out.read_text() == text
    assert parsed(spark, tmp_path, out.read_text())[1:] == tuple(first)


def test_escapes(spark, tmp_path):
    classes = spark.createDataFrame([("a\tb", "c\\d", False, 0), ("  ", "x", False, 1)], "from_name string, to_name string, identity boolean, ord long")
    members = spark.createDataFrame([("a\tb", "f", "n\n", "I", "t\r", 0), ("  ", "f", "q", "I", "w", 0)], "from_class string, kind string, from_name string, desc string, to_name string, ord long")
    out = tmp_path / "e.tiny"
    write_tiny(classes, members, str(out))
    assert out.read_text() == "tiny\t2\t0\tobfuscated\tnamed\nc\ta\\tb\tc\\\\d\n\tf\tn\\n\tI\tt\\r\n"
    assert parsed(spark, tmp_path, out.read_text(), unescape=True)[1:] == ([("a\tb", "c\\d")], [("a\tb", "f", "n\n", "I", "t\r")])
