"""Personal data and secrets replaced by keyed surrogates.

Each detected entity has a kind and a canonical form (digits only, lower case ...). Its surrogate is
drawn from a keyed stream and has the same kind, length, script and shape: letters become letters of
their alphabet (vowels stay vowels), digits become digits, separators stay, a card number passes or
fails its checksum as before, an address stays in its class of network, first names keep their
gender, which all their titles in the corpus settle together. Names are found behind a title and then
wherever they stand in that document. One canonical form has one surrogate everywhere, written in the
case and layout of each mention, so mentions of one entity stay alike.

All distinct entities of the corpus are checked: where two would share a surrogate, or a surrogate is
itself an entity, the later one is drawn again. From the second new draw on a surrogate gets wider
with each one, so a shape that is used up never ends the search: a character more (names, mail,
secrets, numbers), a double name (first names, from the first new draw on), another network (private
addresses go to 10.0.0.0/8; after four draws all go to 2001:db8::/32, reserved for examples).
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, giving_back, id_and_text, read, real_id, with_fields

#: What may stand between the groups of a phone number, marks that noise has put after words included.
_GAP = r"(?:[!#$%&*]{0,3}(?: \| |[ .\-]))?"
# Particles of family names, which stay as they are; a word of a name, which is no title.
_PARTICLE = "(?:von|van|vom|zu|zur|der|den|ter|de|del|della|di|da|do|dos|das|du|la|le|af|al|el|bin|ibn)"
_NAME = r"(?!(?:Mrs?|Ms|Dr|Prof)(?![^\W\d_]))[^\W\d_a-zа-яα-ω](?:[^\W\d_]+(?:['’\-][^\W\d_]+)*|(?:['’\-][^\W\d_]+)+)"
# Kinds in order of precedence, with their patterns.
PATTERNS = [
    ("email", r"[A-Za-z0-9][A-Za-z0-9._%+\-]*@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"),
    ("secret", r"(?:(?<=[\"'=: ])|\b)(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_\-]{20,}|eyJ[\w\-]{10,}\.[\w\-]{10,}\.[\w\-]{10,})|(?i:(?<![A-Za-z])(?:token|secret|passwd|password|pwd|api[_-]?key|access[_-]?key)[\"']?[ \t]*[=:][ \t]*)(?:[\"'](?P<quoted>[^\"'\s]{8,})(?=[\"'])|(?=[A-Za-z0-9_\-./+]*[0-9])(?P<bare>[A-Za-z0-9_\-./+]{8,}))|(?<![0-9A-Za-z])(?:(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])[0-9a-f]{32,}|(?=[0-9A-F]*[A-F])(?=[0-9A-F]*[0-9])[0-9A-F]{32,})(?![0-9A-Za-z])"),
    ("iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"),
    ("ssn", r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"),
    ("card", r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ \-][0-9]{4}){3})(?![0-9])"),
    ("ip", r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])"),
    ("phone", rf"(?<![0-9A-Za-z+])(?:\+[1-9][0-9]{{0,2}}{_GAP})(?:\([0-9]{{2,4}}\){_GAP})?[0-9]{{2,4}}(?:{_GAP}[0-9]{{2,4}}){{1,4}}(?![0-9])|(?<![0-9A-Za-z(])\([0-9]{{3}}\){_GAP}[0-9]{{3}}[ .\-][0-9]{{4}}(?![0-9])|(?<![0-9.\-])[0-9]{{3}}[.\-][0-9]{{3}}[.\-][0-9]{{4}}(?![0-9.\-])"),
    ("person", r"(?<![^\W\d_])(?:(?P<f>Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Signora|Г-жа|Κυρία)|(?P<m>Mr|Herr|Monsieur|Señor|Sr|Signor|Г-н|Κύριος)|(?P<n>Dr|Prof))\.?[ \t](?P<name>(?:%s[ \t])*%s(?:[ \t](?:%s[ \t])*%s)*)" % (_PARTICLE, _NAME, _PARTICLE, _NAME)),
]
# First names by script and gender.
FIRST = {
    ("latin", "f"): "Anna Clara Diana Elena Greta Irene Julia Laura Maria Nora Paula Rosa Sofia Tina Vera".split(),
    ("latin", "m"): "Adam Bruno Carl Daniel Emil Felix Hugo Ivan Jonas Leon Marco Oscar Paul Simon Victor".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Денис Иван Олег Павел Фёдор".split(),
    ("greek", "f"): "Άννα Ειρήνη Ελένη Μαρία Σοφία".split(),
    ("greek", "m"): "Ανδρέας Γιάννης Κώστας Νίκος Πέτρος".split(),
}
# Vowels and consonants by script.
ALPHABETS = [("aeiou", "bcdfghjklmnpqrstvwxyz"), ("аеиоуэюя", "бвгджзклмнпрстфхцчш"), ("αεηιουω", "βγδζθκλμνξπρστφχψ")]
_FIND = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS))
_MAYBE = re.compile("[0-9@]|" + "|".join(["Mr", "Ms", "Miss", "Frau", "Madame", "Mme", "Señor", "Sr", "Signor", "Г-", "Κύρι", "Κυρί", "Herr", "Monsieur", "Dr", "Prof", "sk-", "gh[pousr]_", "AKIA", "eyJ", "(?i:token|secret|passw|pwd|key)"])).search


def _letter(c: str) -> bool:
    return c.isalpha()


def _cased(c: str) -> bool:
    return c.lower() != c.upper()


def _elsewhere(text: str, named: dict[str, str], taken: list[tuple[int, int]]) -> list[tuple[int, int, str, str]]:
    """Whole words that are a name of this document, in its spelling or in capitals, outside the mentions known."""
    out = []
    for name, kind in named.items():
        for spelling in {name, name.upper()}:
            at = text.find(spelling)
            while at >= 0:
                end = at + len(spelling)
                # scripts without cases don't part words
                whole = not _cased(spelling[0]) or not (_letter(text[at - 1 : at]) or _letter(text[end : end + 1]))
                if whole and not any(a < end and at < b for a, b in taken):
                    out.append((at, end, kind, name.lower()))
                    taken.append((at, end))
                at = text.find(spelling, end)
    return out


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """start, stop, kind and canonical form of each mention, in order. First names and family names are mentions of their own."""
    if not _MAYBE(text):
        return []
    out = []
    named: dict[str, str] = {}
    for m in _FIND.finditer(text):
        kind = next(k for k, _ in PATTERNS if m.group(k) is not None)
        a, b = m.span()
        if kind == "secret":
            for part in ("quoted", "bare"):
                if m.group(part) is not None:
                    a, b = m.span(part)
            out.append((a, b, kind, text[a:b]))
        elif kind == "person":
            gender = "f" if m.group("f") else "m" if m.group("m") else "n"
            a, b = m.span("name")
            parts = [p for p in re.finditer(r"\S+", text[a:b]) if not re.fullmatch(_PARTICLE, p.group())]
            for i, p in enumerate(parts):
                which = "family" if i == len(parts) - 1 else f"first_{gender}"
                name = re.sub("['’]s$", "", p.group())
                out.append((a + p.start(), a + p.start() + len(name), which, name.lower()))
                named.setdefault(name, which)
        elif kind == "email":
            out.append((a, b, kind, text[a:b].lower()))
        elif kind == "ip":
            out.append((a, b, kind, text[a:b]))
        elif kind == "iban":
            out.append((a, b, kind, re.sub(r"\W", "", text[a:b])))
        elif kind != "phone" or 7 <= sum(c.isdigit() for c in text[a:b]) <= 15:
            out.append((a, b, kind, re.sub(r"\D", "", text[a:b])))
    if named:
        out = sorted(out + _elsewhere(text, named, [x[:2] for x in out]))
    return out


class _Stream:
    """Numbers from a keyed hash."""

    def __init__(self, key: bytes, *what: str) -> None:
        self.key, self.what, self.n, self.left = key, "\0".join(what).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left += hmac.new(self.key, self.what + self.n.to_bytes(4, "big"), hashlib.sha256).digest()
            self.n += 1
        got, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return got % n


@lru_cache(10_000)
def _pool(c: str) -> str:
    """Characters that may stand for a letter or digit in lower case: of its alphabet, or of its script in its block."""
    for vowels, consonants in ALPHABETS:
        if c in vowels or c in consonants:
            return vowels if c in vowels else consonants
    script = unicodedata.name(c, "").split(" ")[0].split("-")[0]
    for name, (vowels, consonants) in zip(("LATIN", "CYRILLIC", "GREEK"), ALPHABETS, strict=True):
        if script == name:
            return vowels + consonants
    first, kind = ord(c) & ~0xFF, unicodedata.category(c)
    return "".join(x for x in map(chr, range(first, first + 256)) if unicodedata.category(x) == kind and unicodedata.name(x, "").split(" ")[0].split("-")[0] == script)


def _char(c: str, s: _Stream) -> str:
    if "0" <= c <= "9":
        return str(s.below(10))
    if not c.isalnum():
        return c
    low = c.lower()
    if len(low) != 1 or not (pool := _pool(low)):
        return c
    new = pool[s.below(len(pool))]
    return new.upper() if c != low else new


def _luhn(digits: str) -> int:
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10


def _script(name: str) -> str | None:
    scripts = {unicodedata.name(c, "").split(" ")[0].lower() for c in name if c.isalpha()}
    return next((x for x in ("latin", "cyrillic", "greek") if scripts == {x}), None)


def surrogate(key: bytes, kind: str, canonical: str, attempt: int = 0) -> str:
    """A canonical form for another one; never the same. Later attempts are wider (see the module)."""
    salt = 0
    while True:
        wide = max(0, attempt - 1) + salt // 20
        s = _Stream(key, "name" if kind == "family" or kind.startswith("first_") else kind, canonical, f"{attempt}.{salt}")
        digits = lambda n: "".join(str(s.below(10)) for _ in range(n))  # noqa: E731, B023
        like = lambda text: "".join(_char(c, s) for c in text)  # noqa: E731, B023
        if kind == "email":
            local, _, domain = canonical.partition("@")
            labels = domain.split(".")
            keep = min(2, len(labels) - 1) if labels[-2:-1] == ["example"] else 1
            new = like(local + "ab" * wide) + "@" + ".".join([like(x) for x in labels[:-keep]] + labels[-keep:])
        elif kind == "secret":
            hexed = "0123456789abcdef" if re.fullmatch("[0-9a-f]+", canonical) else "0123456789ABCDEF" if re.fullmatch("[0-9A-F]+", canonical) else None
            head = re.match(r"AKIA|gh[pousr]_|sk-|eyJ|", canonical).group()
            rest = canonical[len(head) :]
            if not any(c.isalnum() for c in rest):  # a masked one
                rest = "".join("bae7"[i % 4] for i in range(len(rest)))
            rest += "b7" * wide
            new = head + ("".join(hexed[s.below(16)] for _ in rest) if hexed else like(rest))
        elif kind == "card":
            new = canonical[0] + digits(len(canonical) - 2 + wide)
            valid = _luhn(canonical) == 0
            last = [str(d) for d in range(10) if (_luhn(new + str(d)) == 0) == valid]
            new += last[s.below(len(last))]
        elif kind == "ip":
            a, b, *_ = map(int, canonical.split("."))
            fixed = 1 if a in (0, 10, 127) or a >= 224 else 2 if (a, b) in ((192, 168), (169, 254)) or a == 172 and 16 <= b < 32 else 0
            head = canonical.split(".")[:fixed] or [str([x for x in range(1, 224) if x not in (10, 127, 169, 172, 192)][s.below(218)])]
            if wide and fixed:
                head = ["10"]
            new = ".".join(head + [str(s.below(256)) for _ in range(4 - len(head))])
            if wide >= 4:
                new = "2001:db8:" + ":".join(f"{s.below(1 << 16):x}" for _ in range(6))
        elif kind == "phone":
            head = canonical[:1] if len(canonical) > 10 else ""
            new = head + str(2 + s.below(8)) + digits(len(canonical) - len(head) - 1 + wide)
        elif kind == "iban":
            body = like(canonical[4:] + "0" * wide)
            number = "".join(str(int(c, 36)) for c in body + canonical[:2])
            new = f"{canonical[:2]}{98 - int(number + '00') % 97:02d}{body}"
        elif kind.startswith("first_") and (script := _script(canonical)):
            gender = kind[-1] if kind[-1] != "n" else "fm"[s.below(2)]
            pool = FIRST[script, gender]
            new = pool[s.below(len(pool))].lower()
            if attempt or salt:  # beyond the list: a double name
                new += "-" + pool[s.below(len(pool))].lower() + like(new[0] * wide)
        else:
            new = like(canonical)
            if wide:
                new += like("ab" * wide if canonical[-1] < "\x80" else canonical[-1] * wide)
        if new != canonical:
            return new
        salt += 1


def _title(name: str) -> str:
    return "-".join(p[:1].upper() + p[1:] for p in name.split("-"))


def written(kind: str, mention: str, new: str) -> str:
    """A new canonical form in the layout and case of a mention; what a wider one has more stands at the end."""
    if kind in ("card", "phone", "ssn", "iban"):
        it = iter(new)
        last = max((i for i, c in enumerate(mention) if c.isalnum()), default=-1) + 1
        return "".join(next(it) if c.isalnum() else c for c in mention[:last]) + "".join(it) + mention[last:]
    if kind == "family" and len(new) == len(mention):
        return "".join(n.upper() if c.isupper() else n for c, n in zip(mention, new, strict=True))
    if kind == "family" or kind.startswith("first_"):
        return new.upper() if mention.isupper() and len(mention) > 1 else _title(new)
    if kind == "email":
        if len(new) == len(mention):
            return "".join(n.upper() if c.isupper() else n for c, n in zip(mention, new, strict=True))
        return new.upper() if mention.isupper() else new
    return new


FOUND = "array<struct<start: long, stop: long, kind: string, canonical: string>>"
_FOUND = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.string()), ("canonical", pa.string())]))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and the mentions of every row: array of start, stop (code points), kind, canonical.

    Null and empty texts have none; a long text is read whole. Rows may repeat; an empty table gives no rows; other
    columns are ignored.
    """

    def run(batches):
        for batch in batches:
            found = [[{"start": a, "stop": b, "kind": k, "canonical": c} for a, b, k, c in entities(t)] for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(found, _FOUND)], names=["id", "mentions"])

    out = id_and_text(docs, id_col, text_col).mapInArrow(giving_back(run), f"id long, mentions {FOUND}")
    return out.select(real_id().alias(id_col), "mentions")


def _of_names(kind):
    return (kind == "family") | kind.startswith("first_")


def assignments(found: DataFrame, key: bytes) -> DataFrame:
    """kind, canonical, attempt, surrogate of all distinct entities (kind, canonical, and n if they are counted already).

    Surrogates differ from each other and from all entities of a kind; all names are one kind here. A name is a first
    name if it stands as one at least as often as last, with the gender that most of its titles tell, else the one whose
    list has it; otherwise a family name. Repeated entities count; an empty table gives no rows. Each round draws again what
    collides, wider, until nothing does.
    """

    @F.pandas_udf("string")
    def drawn(kind, canonical, attempt):
        return kind.combine(canonical, lambda k, c: (k, c)).combine(attempt, lambda kc, a: surrogate(key, *kc, int(a)))

    def draw(df):
        return df.withColumn("surrogate", drawn("kind", "canonical", "attempt"))

    told = found.groupBy("kind", "canonical").agg((F.sum("n") if "n" in found.columns else F.count("*")).alias("n"))
    name = _of_names(F.col("kind"))
    times = lambda k: F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k)
    listed = lambda g: F.col("canonical").isin([x.lower() for (_, h), names in FIRST.items() if h == g for x in names])
    f, m, n, family = (F.col(k) for k in ("first_f", "first_m", "first_n", "family"))
    gender = F.when(f > m, "f").when(m > f, "m").when(listed("f"), "f").when(listed("m"), "m").when(f > 0, "f").otherwise("n")
    names = told.where(name).groupBy("canonical").agg(*map(times, ("first_f", "first_m", "first_n", "family")))
    names = names.select(F.when(f + m + n >= family, F.concat(F.lit("first_"), gender)).otherwise("family").alias("kind"), "canonical")
    known = cut_lineage(draw(told.where(~name).select("kind", "canonical").unionByName(names).withColumn("attempt", F.lit(0))))
    one = F.when(name, "name").otherwise(F.col("kind")).alias("one")
    while True:  # ends, as forms get wider with each draw
        marked = known.withColumn("one", one)
        first = marked.groupBy("one", "surrogate").agg(F.min(F.struct("attempt", "canonical"))["canonical"].alias("holder"))
        entity = marked.select("one", F.col("canonical").alias("surrogate"), F.lit(True).alias("taken"))
        marked = marked.join(first, ["one", "surrogate"]).join(entity, ["one", "surrogate"], "left")
        marked = marked.withColumn("again", (F.col("holder") != F.col("canonical")) | F.col("taken").isNotNull())
        if marked.where("again").isEmpty():
            return known
        known = cut_lineage(draw(marked.select("kind", "canonical", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"))))


#: Bytes of entities with another draw than their first that go to all workers at once.
BROADCAST = 8_000_000


def pseudonymise(docs: DataFrame, key: bytes | str, id_col: str = "doc_id", text_col: str = "text", n_col: str | None = "n_entities", broadcast: int = BROADCAST) -> DataFrame:
    """All rows and columns, with the text's entities replaced; n_col: the number of mentions, if not None.

    A null text stays null and an empty one empty; texts without entities don't change; a long text is read whole. Rows may
    repeat; an empty table gives no rows. Other columns stay as they are; where one of them is called n_col, the number's
    name gets underscores until it is free.
    """
    key = key.encode() if isinstance(key, str) else key
    while n_col in docs.columns:
        n_col += "_"
    found = detect(docs, id_col, text_col).select(F.explode("mentions").alias("m")).select("m.kind", "m.canonical")
    found = cut_lineage(found.groupBy("kind", "canonical").agg(F.count("*").alias("n")))
    known = assignments(found, key)
    # entities that don't have the first draw of the kind they are met as
    settled = F.struct(F.col("kind").alias("settled"), "attempt")
    names = found.where(_of_names(F.col("kind"))).select("kind", "canonical").join(known.where(_of_names(F.col("kind"))).select("canonical", settled.alias("to")), "canonical")
    changed = names.unionByName(known.where(~_of_names(F.col("kind"))).select("kind", "canonical", settled.alias("to"))).where("to.attempt > 0 OR to.settled != kind")
    changed = cut_lineage(changed.select(F.concat_ws("\0", "kind", "canonical").alias("what"), F.concat_ws("\0", "to.settled", F.col("to.attempt").cast("string")).alias("to")))
    size = changed.agg(F.sum(F.octet_length("what") + F.octet_length("to"))).first()[0] or 0
    columns = [f"_{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*columns)
    text = columns[docs.columns.index(text_col)]
    schema = with_fields(plain.schema, **({"_n": "long"} if n_col else {}))
    everywhere = docs.sparkSession.sparkContext.broadcast(dict(changed.collect()) if size <= broadcast else {})

    def run(batches):
        draw = lru_cache(100_000)(lambda kind, canonical, attempt: surrogate(key, kind, canonical, attempt))
        for batch in batches:
            texts, counts = [], []
            special = batch["_to"].to_pylist() if "_to" in batch.schema.names else [None] * len(batch)
            for t, to in zip(batch[text].to_pylist(), special, strict=True):
                to = everywhere.value if to is None else dict(to)
                mentions = entities(t) if t else []
                at, out = 0, []
                for a, b, kind, canonical in mentions:
                    kind, attempt = to.get(f"{kind}\0{canonical}", f"{kind}\0000").split("\0")
                    out += [t[at:a], written(kind, t[a:b], draw(kind, canonical, int(attempt)))]
                    at = b
                texts.append("".join([*out, t[at:]]) if mentions else t)
                counts.append(len(mentions))
            kept = [pa.array(texts, pa.string()) if c == text else batch[c] for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(counts, pa.int64())] * bool(n_col)], names=[*columns, *["_n"] * bool(n_col)])

    if size <= broadcast:
        out = plain.mapInArrow(giving_back(run), schema)
    else:
        some = F.coalesce(F.octet_length(text), F.lit(0)) > 0
        out = _with_changed(plain.where(some), changed, text).mapInArrow(giving_back(run), schema).unionByName(plain.where(~some).mapInArrow(giving_back(run), schema))
    return out.toDF(*docs.columns, *[n_col] * bool(n_col))


def _with_changed(rows: DataFrame, changed: DataFrame, text: str) -> DataFrame:
    """Adds to each row the map _to of its changed entities, looked up by the text's hash: distinct texts' entities travel, then rows."""
    mark = F.sha2(text, 256)

    def run(batches):
        for batch in batches:
            out = {(h, f"{k}\0{c}") for h, t in zip(batch["mark"].to_pylist(), batch["t"].to_pylist(), strict=True) for _, _, k, c in entities(t)}
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.string()) for x in (zip(*out, strict=True) if out else ([], []))], names=["mark", "what"])

    met = rows.select(mark.alias("mark"), F.col(text).alias("t")).mapInArrow(giving_back(run), "mark string, what string").distinct()
    found = met.join(changed, "what").groupBy("mark").agg(F.map_from_entries(F.collect_list(F.struct("what", "to"))).alias("_to"))
    return rows.withColumn("mark", mark).join(found, "mark", "left").drop("mark")


#: The registered queries' key; callers have their own.
DEMO_KEY = "surrogate-demo-key"


def op8_pii_surrogates(spark, sf_dir):
    return pseudonymise(read(spark, sf_dir).select("doc_id", "text"), DEMO_KEY)
