"""Personal data replaced by keyed surrogates, with DataFrame functions only.

Mentions are found by one pattern. Mentions of one entity (an address in any case, a number with any separators) share
a canonical form, and so one surrogate wherever they stand. A surrogate keeps the kind and the format: digits stay
digits, letters letters of the same case, separators stay, card numbers pass their checksum, names keep gender and
script. Surrogates come from a keyed hash; those that meet each other, an entity of the corpus or an earlier choice
are drawn again until all differ.

Only rows with mentions are shuffled, and only entities are compared. Entities with more than a thousandth of all
mentions number at most a thousand, so they are joined by broadcast and cannot crowd one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .registry import query

# Forms of address by gender, and names by script and gender.
FEMALE = "Mrs Ms Miss Madam Frau Señora Sra Madame Mme Mademoiselle Г-жа Госпожа".split()
MALE = "Mr Sir Herr Señor Monsieur Г-н Господин".split()
NAMES = {
    ("latin", "f"): "Anna Berta Clara Dora Elena Frida Greta Hanna Irma Julia Karla Laura Maria Nora Olga Petra".split(),
    ("latin", "m"): "Anton Boris Conrad David Emil Felix Georg Hugo Ivan Jonas Karl Lukas Martin Niklas Otto Paul".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Зоя Ирина Ксения Лидия Мария Нина Ольга".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег".split(),
}
SURNAMES = {
    "latin": "Abel Berger Carver Dorn Ellis Falk Garner Holm Irving Jansen Keller Lindt Moser Nolan Ortner Perrin Quill Renner Stone Tanner Ulmer Vance Weller York Zander".split(),
    "cyrillic": "Абрамов Белов Волков Громов Дымов Ершов Жуков Зимин Ильин Котов Лосев Мельник Носов Орлов".split(),
}

TITLES = "|".join([*FEMALE, *MALE, "Dr", "Prof"])
INITIALS = "".join(sorted({t[0] for t in TITLES.split("|")}))
# Each starts with a cheap look at the next character, so that most places of a text fail at once.
PATTERNS = {
    "email": r"(?=[A-Za-z0-9._%+-])(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?=[0-9A-Fa-f])(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])",
    "iban": r"(?=[A-Z])(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv4": r"(?=[0-9])(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "phone": r"(?=[+(])(?:\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9]))",
    "ssn": r"(?=[0-9])(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?=[0-9])(?<![0-9.-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])",
    "name": rf"(?=[{INITIALS}])(?<![\p{{L}}])(?:{TITLES})\.? \p{{Lu}}[\p{{L}}'-]+(?: (?!(?:{TITLES})\b)\p{{Lu}}[\p{{L}}'-]+){{0,2}}",
}
ANY = "|".join(PATTERNS.values())
#: What every text with a mention has: a digit, an at sign, or a form of address.
HINT = rf"[0-9@]|(?=[{INITIALS}])(?:{TITLES})\.? \p{{Lu}}"

KEY = "surrogate-key"
#: Entities that a task makes replacements for: few bytes, much work.
DRAWN = 2_000


def passes_checksum(digits: Column) -> Column:
    """Luhn's check of a string of digits."""
    reverse = F.transform(F.split(F.reverse(digits), ""), lambda d: F.coalesce(F.try_to_number(d, F.lit("9")), F.lit(0)).cast("int"))
    doubled = F.transform(reverse, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def kind_of(mention: Column) -> Column:
    """The kind of a mention; null for one that only looks like a card."""
    kind = F.lit(None).cast("string")
    for name in reversed(PATTERNS):
        whole = mention.rlike(rf"^(?:{PATTERNS[name]})$")
        if name == "card":
            whole = whole & passes_checksum(F.regexp_replace(mention, "[^0-9]", ""))
        kind = F.when(whole, name).otherwise(kind)
    return kind


def canonical(kind: Column, mention: Column) -> Column:
    """What mentions of one entity have in common."""
    return (
        F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(mention, "[^0-9+]", ""))
        .when(kind == "iban", F.regexp_replace(mention, " ", ""))
        .when(kind == "name", F.regexp_replace(mention, rf"^(?:{TITLES})\.? ", ""))
        .otherwise(F.lower(mention))
    )


def gender_of(kind: Column, mention: Column) -> Column:
    female = mention.rlike(rf"^(?:{'|'.join(FEMALE)})\b") | F.split(mention, " ")[1].isin(
        [n for (_, g), names in NAMES.items() if g == "f" for n in names]
    )
    return F.when(kind == "name", F.when(female, "f").otherwise("m"))


def pick(digest: Column, i: Column, size: int) -> Column:
    """A number below ``size`` from place ``i`` of a hexadecimal digest of 128 digits."""
    return (F.conv(F.substring(digest, F.pmod(i * 3, F.lit(120)) + 1, F.lit(5)), 16, 10).cast("bigint") % size).cast("int")


def character(letters: str, at: Column) -> Column:
    return F.substring(F.lit(letters), at + 1, F.lit(1))


def redrawn(value: Column, digest: Column, keep: Column, hexadecimal: bool = False) -> Column:
    """Every digit and letter of ``value`` after the first ``keep`` ones exchanged, everything else as it is."""
    digits, lower, upper = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def step(state, c):
        i = state["i"]
        if hexadecimal:
            low = character("0123456789abcdef", pick(digest, i, 16))
            new = F.when(c.rlike("[A-F]"), F.upper(low)).when(c.rlike("[0-9a-f]"), low)
        else:
            new = (
                F.when(c.rlike("[0-9]"), character(digits, pick(digest, i, 10)))
                .when(c.rlike("[a-z]"), character(lower, pick(digest, i, 26)))
                .when(c.rlike("[A-Z]"), character(upper, pick(digest, i, 26)))
            )
        out = F.when(new.isNull() | (i < keep), c).otherwise(new)
        return F.struct((i + new.isNotNull().cast("int")).alias("i"), F.concat(state["s"], out).alias("s"))

    start = F.struct(F.lit(0).alias("i"), F.lit("").alias("s"))
    return F.aggregate(F.split(value, ""), start, step)["s"]


def with_check_digit(digits: Column) -> Column:
    """A card number whose last digit is set so that it passes the checksum."""
    stem = F.substring(digits, F.lit(1), F.length(digits) - 1)
    tries = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(stem, d.cast("string")))
    return F.filter(tries, passes_checksum)[0]


def new_name(value: Column, gender: Column, digest: Column, attempt: Column) -> Column:
    """As many name parts as before, given names of the gender and all of the script; the digest decides.

    The surname is a double one, and longer by a name after every second attempt, so that names never run out.
    """
    cyrillic = value.rlike(r"\p{IsCyrillic}")

    def from_list(names: list[str], i: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, names)), pick(digest, i, len(names)) + 1)

    def part(i: Column, last: Column, script: str) -> Column:
        places = F.sequence(F.lit(0), 1 + F.floor(attempt / 2).cast("int"))
        surname = F.array_join(F.transform(places, lambda k: from_list(SURNAMES[script], i + 11 * k)), "-")
        given = F.when(gender == "f", from_list(NAMES[script, "f"], i)).otherwise(from_list(NAMES[script, "m"], i))
        return F.when(last, surname).otherwise(given)

    parts = F.split(value, " ")
    new = F.transform(
        parts,
        lambda _, i: F.when(cyrillic, part(i, i == F.size(parts) - 1, "cyrillic")).otherwise(
            part(i, i == F.size(parts) - 1, "latin")
        ),
    )
    return F.array_join(new, " ")


def surrogate(kind: Column, value: Column, gender: Column, digest: Column, attempt: Column) -> Column:
    """The replacement of a canonical entity; addresses get a longer name once a few attempts failed."""
    octets = F.transform(
        F.split(value, r"\."), lambda _, i: F.when(i == 0, 1 + pick(digest, i, 223)).otherwise(pick(digest, i, 256)).cast("string")
    )
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    more = F.when(attempt < 4, "").otherwise(F.substring(digest, F.lit(1), attempt))
    host = F.concat(F.lit("d"), F.substring(F.sha2(F.concat(F.lit(KEY), domain), 256), 1, 10), F.lit(".example."))
    top = F.when(domain.rlike(r"\.(?:org|net|com)$"), F.substring_index(domain, ".", -1)).otherwise("com")
    return (
        F.when(kind == "email", F.concat(redrawn(local, digest, F.lit(0)), more, F.lit("@"), host, top))
        .when(kind == "ipv4", F.array_join(octets, "."))
        .when(kind == "phone", redrawn(value, digest, F.when(value.startswith("+"), 1).otherwise(0)))
        .when(kind == "card", with_check_digit(redrawn(value, digest, F.lit(1))))
        .when(kind == "iban", redrawn(value, digest, F.lit(2)))
        .when(kind == "secret", redrawn(value, digest, F.lit(0), hexadecimal=True))
        .when(kind == "name", new_name(value, gender, digest, attempt))
        .otherwise(redrawn(value, digest, F.lit(0)))
    )


def formatted(kind: Column, mention: Column, new: Column) -> Column:
    """The canonical replacement in the format of a mention: its separators, its title, its case."""

    def step(state, c):
        digit = c.rlike("[0-9A-Z+]")
        out = F.when(digit, F.substring(new, state["i"] + 1, F.lit(1))).otherwise(c)
        return F.struct((state["i"] + digit.cast("int")).alias("i"), F.concat(state["s"], out).alias("s"))

    start = F.struct(F.lit(0).alias("i"), F.lit("").alias("s"))
    spaced = F.aggregate(F.split(mention, ""), start, step)["s"]
    title = F.regexp_extract(mention, rf"^(?:{TITLES})\.? ", 0)
    shouted = (mention == F.upper(mention)) & (mention != F.lower(mention))
    return (
        F.when(kind.isin("phone", "card", "ssn", "iban"), spaced)
        .when(kind == "name", F.concat(title, new))
        .when(shouted, F.upper(new))
        .otherwise(new)
    )


def surrogate_table(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, new) for entities (kind, value, gender): all replacements of a kind differ, and are no entity.

    Names and addresses grow with the attempts, so the rounds end however many there are. Kinds of fixed format need
    twice as many numbers in their format as there are entities.
    """
    tasks = max(1, -(-entities.count() // DRAWN))
    left = entities.select("kind", "value", "gender").withColumn("attempt", F.lit(0)).repartition(tasks, "kind", "value")
    done = None
    while True:
        digest = F.sha2(F.concat_ws("|", F.lit(key), "kind", "value", "attempt"), 512)
        made = surrogate(F.col("kind"), F.col("value"), F.col("gender"), digest, F.col("attempt"))
        drawn = written(left.withColumn("new", made), "surrogates-drawn")
        first = drawn.groupBy("kind", "new").agg(F.min("value").alias("winner"))
        taken = entities.select("kind", F.col("value").alias("new"))
        if done is not None:
            taken = taken.union(done.select("kind", "new"))
        free = first.join(taken.distinct(), ["kind", "new"], "left_anti").withColumn("free", F.lit(True))
        judged = written(
            drawn.join(free, ["kind", "new"], "left").withColumn(
                "good", F.coalesce(F.col("free") & (F.col("winner") == F.col("value")), F.lit(False))
            ),
            "surrogates",
        )
        good = judged.where("good").select("kind", "value", "new")
        done = good if done is None else done.union(good)
        left = judged.where("not good").select("kind", "value", "gender", (F.col("attempt") + 1).alias("attempt"))
        if not left.take(1):
            return done


def replaced(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """(row struct, n_entities, kinds, new_text) for every row of ``docs``, the row struct holding all its columns.

    Texts that are null or hold no mention come back as they are, with no kinds. Rows need no key and may repeat.
    Numbers that look like cards but fail the checksum are left alone.
    """
    found = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.when(F.col(f"`{text}`").rlike(HINT), F.regexp_extract_all(F.col(f"`{text}`"), F.lit(ANY), F.lit(0))).alias("mentions"),
    )
    some = F.coalesce(F.size("mentions"), F.lit(0)) > 0
    nothing = F.array().cast("array<string>")
    plain = found.where(~some).select(
        "row", F.lit(0).cast("bigint").alias("n_entities"), nothing.alias("kinds"), F.col(f"row.`{text}`").alias("new_text")
    )
    touched = written(found.where(some).withColumn("rid", F.monotonically_increasing_id()), "surrogate-rows")
    mention = touched.select("rid", F.posexplode("mentions").alias("place", "mention"))
    kind = kind_of(F.col("mention"))
    mention = mention.withColumn("kind", kind).withColumn("value", canonical(F.col("kind"), F.col("mention")))
    mention = written(mention.withColumn("gender", gender_of(F.col("kind"), F.col("mention"))), "surrogate-mentions")
    real = mention.where(F.col("kind").isNotNull())
    entities = written(
        real.groupBy("kind", "value").agg(F.min("gender").alias("gender"), F.count("*").alias("n")), "surrogate-entities"
    )
    total = entities.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    new = surrogate_table(entities, key).join(entities.select("kind", "value", "n"), ["kind", "value"])
    new = written(new, "surrogate-map")
    frequent = F.col("n") * 1000 > total
    hot = new.where(frequent).select("kind", "value", F.col("new").alias("hot_new"))  # at most 1000 rows
    marked = mention.join(F.broadcast(hot), ["kind", "value"], "left")
    rare = marked.where("hot_new is null and kind is not null").join(
        new.where(~frequent).select("kind", "value", "new"), ["kind", "value"]
    )
    settled = (
        marked.where("hot_new is not null or kind is null")
        .withColumn("new", F.col("hot_new"))
        .unionByName(rare)
        .select(
            "rid",
            "place",
            "kind",
            F.coalesce(formatted(F.col("kind"), F.col("mention"), F.col("new")), F.col("mention")).alias("out"),
        )
    )
    by_row = settled.groupBy("rid").agg(
        F.array_sort(F.collect_list(F.struct("place", "out", "kind"))).alias("outs"),
        F.count("kind").alias("n_entities"),
    )
    gaps = F.split(F.col(f"row.`{text}`"), ANY, -1)
    pieces = F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.try_element_at("outs.out", i + 1), F.lit(""))))
    changed = touched.join(by_row, "rid").select(
        "row",
        "n_entities",
        F.array_sort(F.array_distinct(F.filter("outs.kind", lambda k: k.isNotNull()))).alias("kinds"),
        F.array_join(pieces, "").alias("new_text"),
    )
    return plain.unionByName(changed)


def with_surrogates(docs: DataFrame, text: str = "text", key: str = KEY, length: str | None = "n_chars") -> DataFrame:
    """``docs`` with the text replaced, columns and their order kept; ``length`` is counted anew where a text changed."""
    out = []
    for c in docs.columns:
        column = F.col(f"row.`{c}`")
        if c == text:
            column = F.col("new_text")
        elif c == length:
            kind = docs.schema[c].dataType
            column = F.when(F.col("n_entities") > 0, F.length("new_text").cast(kind)).otherwise(column)
        out.append(column.alias(c))
    return replaced(docs, text, key).select(*out)


@query()
def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = replaced(table(spark, sf_dir, "documents"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_entities", "kinds", F.col("new_text").alias("text"))
