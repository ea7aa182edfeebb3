"""Class files decoded and rewritten, archives transferred as a whole, tools and streams."""

import glob
import json
import os
import random
import struct
import sys
import time
import zipfile
from pathlib import Path

import pyspark
import pytest
from classbuilder import Builder, sample, write_jar
from pyspark.sql import functions as F

from symtransfer.config import TransferConfig
from symtransfer.plans import jars
from symtransfer.plans.frontends import Side, with_sizes
from symtransfer.sinks import external
from symtransfer.sinks.jar import is_signature, rewrite_jar
from symtransfer.sources.classfile import ClassFormatError, Names, decode, plain_opcode, rewrite
from symtransfer.sources.jar import in_order, read_entry, read_jar, scan
from symtransfer.streaming.incremental import match_stream

EXTRA = {"Foo": (1, []), "Bar": (3, [("get", "()I")]), "Baz": (5, [("get", "()I"), ("set", "(Ljava/lang/String;)V")])}


def loads(spark, jar, name):
    jvm = spark._jvm
    urls = spark.sparkContext._gateway.new_array(jvm.java.net.URL, 1)
    urls[0] = jvm.java.io.File(jar).toURI().toURL()
    return jvm.java.lang.Class.forName(name.replace("/", "."), True, jvm.java.net.URLClassLoader(urls))


def test_decode():
    b = Builder("p/A", "p/Base", ["java/lang/Runnable"])
    b.field("a", "I", 0x19, b.int(7))
    b.field("l", "J", 0x19, b.long(7))
    b.field("s", "Ljava/lang/String;", 0x19, b.string("x"))
    b.field("n", "I")
    call = struct.pack(">H", b.ref(10, "p/B", "go", "(I)V"))
    table = b"\xaa\0\0" + struct.pack(">iiiii", 20, 0, 1, 20, 20)  # at 1: padded to 4
    code = b"\x1b" + table + b"\xc4\x15\0\x01" + b"\x12" + bytes([b.int(9)]) + b"\xb6" + call + b"\xbb" + struct.pack(">H", b.cls("p/C")) + b"\xb1"
    b.method("run", "(I)V", code)
    b.method("gone", "()V", access=0x401)
    c = decode(b.bytes())
    assert (c["name"], c["super"], c["interfaces"]) == ("p/A", "p/Base", ["java/lang/Runnable"])
    assert [f["init_tag"] for f in c["fields"].values()] == [1, 3, 5, 0]
    run = c["methods"]["run", "(I)V"]
    assert run["ops"] == [21, 170, 21, 18, 182, 187, 177]
    assert run["tags"] == ["", "", "", "k1", "(I)V", "p/C", ""]
    assert c["methods"]["gone", "()V"]["ops"] == []
    assert [plain_opcode(x) for x in (26, 45, 59, 78, 19, 20, 200, 201)] == [21, 25, 54, 58, 18, 18, 167, 168]
    for bad in (b"", b"junk", b.bytes()[:60]):
        with pytest.raises(ClassFormatError):
            decode(bad)


def real_jar():
    return min(glob.glob(os.path.dirname(pyspark.__file__) + "/jars/json4s*.jar") or glob.glob(os.path.dirname(pyspark.__file__) + "/jars/*.jar"), key=os.path.getsize)


def test_real_archives_decode_and_survive_rewriting(spark):
    """Without new names a class doesn't change; with them it still decodes, and has the same opcodes."""
    with zipfile.ZipFile(real_jar()) as z:
        entries = [(n, z.read(n)) for n in z.namelist() if n.endswith(".class") and "module-info" not in n][:120]
    classes = {decode(d)["name"]: decode(d) for _, d in entries}
    new = {n: f"renamed/C{i}" for i, n in enumerate(classes)}
    names = Names(new, {})
    for _, data in entries:
        before = decode(data)
        assert rewrite(data, Names({}, {})) == (before["name"], data)
        name, out = rewrite(data, names)
        after = decode(out)
        assert after["name"] == name == new[before["name"]]
        assert [m["ops"] for m in after["methods"].values()] == [m["ops"] for m in before["methods"].values()]
        assert not any(f"L{old};" in d for old in classes for _, d in after["methods"])


def test_real_classes_load_after_renaming(spark, tmp_path):
    jar = next(iter(glob.glob(os.path.dirname(pyspark.__file__) + "/jars/gson-*.jar")), None)
    if jar is None:
        pytest.skip("no such archive")
    side = scan(spark, jar).where("error IS NULL AND entity_id LIKE 'com/google/gson/%'")
    classes = side.select(F.col("entity_id").alias("from_name"), F.replace("entity_id", F.lit("com/google/gson"), F.lit("my/own")).alias("to_name"))
    members = spark.createDataFrame([("com/google/gson/Gson", "m", "toJson", "(Ljava/lang/Object;)Ljava/lang/String;", "write")], "from_class string, kind string, from_name string, desc string, to_name string")
    out = str(tmp_path / "own.jar")
    done = rewrite_jar(spark, jar, out, classes, members)
    assert done["class"] > 50 and not done["collisions"] and not done.get("error")
    loaded = loads(spark, out, "my/own/Gson")
    gson = loaded.getDeclaredConstructor(spark.sparkContext._gateway.new_array(spark._jvm.java.lang.Class, 0)).newInstance(spark.sparkContext._gateway.new_array(spark._jvm.java.lang.Object, 0))
    methods = {m.getName() for m in loaded.getDeclaredMethods()}
    assert "write" in methods and gson.toString()


def test_signatures_and_names():
    names = Names({"a/B": "x/Y", "a/B$C": "x/Y$Z"}, {("a/B", "f"): {("n", "I"): "one", ("n", "J"): "two", ("m", "I"): "only"}})
    assert names.of_signature("<T:La/B;:Ljava/util/List<La/B;>;>La/B<TT;>.C<[La/B;>;") == "<T:Lx/Y;:Ljava/util/List<Lx/Y;>;>Lx/Y<TT;>.Z<[Lx/Y;>;"
    assert names.of_signature("(TT;ILa/B$C;)V^La/B;") == "(TT;ILx/Y$Z;)V^Lx/Y;"
    assert names.of_signature("<L:Ljava/lang/Object;>La/B<TL;>;") == "<L:Ljava/lang/Object;>Lx/Y<TL;>;"
    assert (names.of_member("a/B", "f", "n", "J"), names.of_member("a/B", "f", "n", "Z"), names.of_member("a/B", "f", "m", "Z"), names.of_member("q", "f", "n", "I")) == ("two", "n", "only", "n")
    assert names.in_type("[La/B;") == "[Lx/Y;"


def test_a_name_that_is_also_a_literal_stays_one():
    b = Builder("a/B")
    b.field("run", "Ljava/lang/String;", 0x19, b.string("run"))
    b.method("run", "()V", b"\xb1")
    _, out = rewrite(b.bytes(), Names({"a/B": "x/Y"}, {("a/B", "m"): {("run", "()V"): "go"}}))
    c = decode(out)
    assert ("go", "()V") in c["methods"] and ("run", "Ljava/lang/String;") in c["fields"] and b"run" in out


def test_scan_keeps_errors_apart(spark, tmp_path):
    jar = write_jar(tmp_path / "a.jar", [("A", sample("A", 1)), ("Bad", b"nonsense"), ("A2", sample("A", 2))], [("x.txt", b"hi")])
    rows = scan(spark, jar).collect()
    assert [(r.entity_id, r.error is None) for r in sorted(rows, key=lambda r: r.ord)] == [("A", True), ("Bad", False), ("A", True)]
    assert [bytes(r.data) for r in read_entry(spark, jar, "x.txt").collect()] == [b"hi"] and read_entry(spark, jar, "none").count() == 0
    side = read_jar(spark, jar)
    assert [r.entity_id for r in in_order(side).collect()] == ["A"]
    assert [(r.entity_id, r.n_fields) for r in side.entity.collect()] == [("A", 2)]


@pytest.fixture
def archives(tmp_path):
    obf = {"Foo": "aaa", "Bar": "aab", "Baz": "aac"}
    target = write_jar(tmp_path / "a.jar", [(f"obfA/{o}", sample(f"obfA/{o}", *EXTRA[n])) for n, o in obf.items()])
    unmapped = write_jar(tmp_path / "b.jar", [(f"obfB/{o}", sample(f"obfB/{o}", *EXTRA[n])) for n, o in obf.items()], [("META-INF/X.SF", b"s"), ("META-INF/x.rsa", b"s"), ("res/x.txt", b"hello")])
    mapping = tmp_path / "map.tiny"
    mapping.write_text("tiny\t2\t0\tobfuscated\tnamed\n" + "".join(f"c\tobfA/{o}\trenamed/{n}\n" for n, o in obf.items()) + "\tf\tf0\tI\tsize\n\tm\tget\t()I\tanswer\n")
    return target, str(mapping), unmapped


def test_archives_end_to_end(spark, tmp_path, archives):
    target, mapping, unmapped = archives
    out = tmp_path / "out"
    seen = []
    result = jars.run(spark, TransferConfig(target, mapping, unmapped, str(out), threshold=0.5), progress=lambda s, p: seen.append((s, p)))
    assert {(r.u, r.target_to, r.matched) for r in result.match.collect()} == {("obfB/aaa", "renamed/Foo", True), ("obfB/aab", "renamed/Bar", True), ("obfB/aac", "renamed/Baz", True)}
    assert all(abs(r.score - 1.0) < 1e-9 for r in result.match.collect())
    lines = (out / "mappings.tiny").read_text().splitlines()
    assert lines[0] == "tiny\t2\t0\tobfuscated\tnamed" and "c\tobfB/aac\trenamed/Baz" in lines and "\tm\tget\t()I\tanswer" in lines and "\tf\tf0\tI\tsize" in lines
    with zipfile.ZipFile(out / "remapped.jar") as z:
        assert sorted(z.namelist()) == ["renamed/Bar.class", "renamed/Baz.class", "renamed/Foo.class", "res/x.txt"]
    for name in ("Foo", "Bar", "Baz"):
        assert loads(spark, str(out / "remapped.jar"), f"renamed/{name}").getSimpleName() == name
    assert "answer" in {m.getName() for m in loads(spark, str(out / "remapped.jar"), "renamed/Baz").getDeclaredMethods()}
    assert [s for s, _ in seen] == [*jars.STAGES, "done"] and seen[-1][1] == 1.0


def test_stages_can_be_cancelled_and_inputs_are_checked(spark, tmp_path, archives):
    target, mapping, unmapped = archives
    with pytest.raises(jars.Cancelled):
        jars.run(spark, TransferConfig(target, mapping, unmapped, str(tmp_path / "o")), cancelled=lambda: True)
    with pytest.raises(ValueError):
        jars.run(spark, TransferConfig(str(tmp_path / "none.jar"), mapping, unmapped, str(tmp_path / "o")))


def test_a_running_job_is_cancelled(spark):
    started = time.monotonic()
    with pytest.raises(jars.Cancelled), jars._cancelling(spark, lambda: time.monotonic() - started > 2, every=0.1):
        spark.range(1).mapInPandas(lambda x: [time.sleep(60)] and x, "id long").collect()
    assert time.monotonic() - started < 50
    assert spark.range(3).count() == 3


def test_unmatched_classes_are_reviewed(spark, tmp_path, archives):
    target, _, unmapped = archives
    mapping = tmp_path / "other.tiny"
    mapping.write_text("tiny\t2\t0\tobfuscated\tnamed\nc\tnot/There\tx/Y\n")
    asked = []

    def ask(name, source):
        asked.append((name, source))
        if len(asked) == 2:
            raise jars.SkipAll
        return "given.Name"

    overrides = spark.createDataFrame([("obfB/aab", "by.Hand")], "entity_id string, name string")
    result = jars.run(spark, TransferConfig(target, str(mapping), unmapped, str(tmp_path / "out")), overrides=overrides, ask=ask, show=lambda path: Path(path).name)
    names = {r.from_name: (r.to_name, r.source) for r in result.classes.collect()}
    assert asked == [("obfB/aaa", "aaa.class"), ("obfB/aac", "aac.class")]
    assert names == {"obfB/aaa": ("given/Name", "override"), "obfB/aab": ("by/Hand", "override"), "obfB/aac": ("obfB/aac", "identity")}
    assert result.kept
    result.release()
    assert not result.kept and result.classes.storageLevel.useMemory is False


def test_colliding_names_are_reported(spark, tmp_path, archives):
    _, _, unmapped = archives
    classes = spark.createDataFrame([("obfB/aaa", "same"), ("obfB/aab", "same")], "from_name string, to_name string")
    members = spark.createDataFrame([], "from_class string, kind string, from_name string, desc string, to_name string")
    done = rewrite_jar(spark, unmapped, str(tmp_path / "c.jar"), classes, members)
    assert done["collisions"] == ["same.class"] and done["signature"] == 2 and done["resource"] == 1
    assert is_signature("META-INF/a.Ec") and not is_signature("a.SF")
    with pytest.raises(OSError):
        rewrite_jar(spark, str(tmp_path / "no.jar"), str(tmp_path / "d.jar"), classes, members)


def test_tools(tmp_path):
    source = tmp_path / "in.class"
    source.write_bytes(b"x")
    make = [sys.executable, "-c", "import sys, pathlib; pathlib.Path(sys.argv[2], 'A.java').write_text('class A {}')"]
    args = lambda i, o, x: [i, o]
    assert external.run_tool(make, str(source), str(tmp_path / "out"), args) == [str(tmp_path / "out" / "A.java")]
    assert external.review_source(make, str(source), args) == "class A {}"
    assert external.review_source([sys.executable, "-c", "raise SystemExit(3)"], str(source), args) == ""
    with pytest.raises(RuntimeError):
        external.run_tool([sys.executable, "-c", "raise SystemExit(3)"], str(source), str(tmp_path / "out"), args)
    with pytest.raises(TimeoutError):
        external.run_tool([sys.executable, "-c", "import time; time.sleep(9)"], str(source), str(tmp_path / "out"), args, timeout_s=0.3)
    with pytest.raises(ValueError):
        external.clean("/usr")
    assert external.available() == ["cfr", "fernflower", "vineflower"] and external.get().name == "cfr"
    with pytest.raises(ValueError):
        external.get("other")
    assert external.get("vineflower").arguments("i", "o", {"a": "1"}) == ["--a=1", "i", "o"]
    with pytest.raises(FileNotFoundError):
        external.decompile(external.get(), [str(tmp_path)], str(source), str(tmp_path / "out"))


def test_entities_that_arrive_are_matched(spark, tmp_path):
    rng = random.Random(2)
    kinds = {f"t{k}": [f"({'I' * rng.randint(0, 4)}{k})V" for _ in range(3)] for k in range(6)}
    member = spark.createDataFrame([(c, "m", i, f"x{i}", d, 1, hash(d) % 1000, d, 0) for c, ds in kinds.items() for i, d in enumerate(ds)], "entity_id string, kind string, ord long, name string, desc string, access int, fine long, coarse string, init_tag int")
    entity = spark.createDataFrame([(c, i, 1, ["S:java/lang/Object"]) for i, c in enumerate(kinds)], "entity_id string, ord int, flags int, refs array<string>")
    targets = Side(with_sizes(entity, member), member)
    (tmp_path / "in").mkdir()
    rows = [{"entity_id": "u" + c[1:], "ord": i, "flags": 1, "refs": ["S:java/lang/Object"]} for i, c in enumerate(kinds)]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    arriving = spark.readStream.schema("entity_id string, ord int, flags int, refs array<string>").json(str(tmp_path / "in"))

    def members(batch):
        known = member.withColumn("entity_id", F.concat(F.lit("u"), F.substring("entity_id", 2, 9)))
        return known.join(batch.select("entity_id"), "entity_id", "left_semi")

    match_stream(arriving, members, targets, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = {r.u: r.t for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"u" + c[1:]: c for c in kinds}
