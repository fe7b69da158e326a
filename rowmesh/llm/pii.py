"""Personal data replaced by surrogates.

Entities are found by patterns. Each distinct entity (type and canonical form, so that one number in two layouts is one
entity) gets a surrogate from a keyed digest: digits for digits, letters for letters, hexadecimal for hexadecimal; a card
keeps its issuer and its Luhn remainder, an IBAN its country and its check, an address its octets. Collision checks then
see to it that distinct entities of a type keep distinct surrogates and that no surrogate is itself an entity of the
corpus; losers try again with the next digest, which after a few attempts grows longer, so that none is left without one
however densely its type is filled. One entity has one surrogate everywhere, and is laid out like the text it replaces.

A person is found by a title. Its name is replaced word by word, each word being an entity, so that ``Mr John Smith``,
``Dr Smith`` and ``John Smith`` stay one person. Words known from a titled mention are replaced wherever they stand in
the same text. Words that lead names oftener than not get given names of the gender that their titles tell, others
made-up family names, of the same script (Latin, Cyrillic or Greek; others become Latin); titles and small words such as
``van der`` stay. Forms that differ in case alone, ``Weiß`` and ``WEISS``, are one.

One scan finds what each text holds and stores it beside the text; all further steps read the few columns they need of
that table. Only entities, and texts that hold some, are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KEY = "surrogates-1"
#: Attempts at the entity's own length; each further one is a character longer.
SAME_LENGTH = 4

#: Titles by gender (m, f, or n where they do not tell).
TITLES = {
    "m": ("Mr", "Herr", "Sr", "Señor", "Monsieur", "Г-н"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Sra", "Señora", "Mme", "Mlle", "Madame", "Г-жа"),
    "n": ("Dr", "Prof"),
}
#: Small words within names, which stay.
PARTICLES = ("van", "von", "der", "den", "de", "la", "las", "los", "del", "della", "di", "da", "dos", "das", "du", "le", "ten", "ter", "zu", "zum", "af", "av", "y", "e")
#: Given names by gender and script (latin, cyrillic, greek).
GIVEN = {
    ("m", "latin"): ("Adrian", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Marco", "Nils", "Oscar", "Paul", "Simon"),
    ("f", "latin"): ("Alice", "Bianca", "Clara", "Diana", "Elena", "Flora", "Greta", "Helena", "Irene", "Julia", "Klara", "Laura", "Maria", "Nora", "Paula", "Sofia"),
    ("n", "latin"): ("Alex", "Andrea", "Chris", "Dana", "Kim", "Lee", "Robin", "Sam"),
    ("m", "cyrillic"): ("Антон", "Борис", "Виктор", "Григорий", "Денис", "Егор", "Иван", "Павел"),
    ("f", "cyrillic"): ("Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Ольга"),
    ("n", "cyrillic"): ("Саша", "Женя", "Валя", "Слава"),
    ("m", "greek"): ("Νίκος", "Γιώργος", "Πέτρος", "Ανδρέας", "Στέφανος", "Μάριος"),
    ("f", "greek"): ("Σοφία", "Μαρία", "Άννα", "Ειρήνη", "Δήμητρα", "Χριστίνα"),
    ("n", "greek"): ("Αλέξης", "Χάρις"),
}
#: Syllables of made-up family names.
SYLLABLES = {
    "latin": ("ba", "be", "bo", "da", "del", "fa", "gar", "ha", "ka", "lan", "ma", "mer", "na", "nor", "pa", "ra", "sen", "ta", "ver", "zo"),
    "greek": ("βα", "γε", "δη", "ζω", "θε", "κα", "λα", "μο", "να", "ξε", "πα", "ρη", "σα", "τι", "φο", "χα", "ψα", "λε", "μα", "νι"),
    "cyrillic": ("ба", "бо", "ва", "го", "да", "ка", "ла", "лен", "ма", "мо", "на", "но", "па", "ро", "са", "сен", "та", "то", "фа", "ша"),
}

_TITLE = "(?:" + "|".join(sorted((t for group in TITLES.values() for t in group), key=len, reverse=True)) + ")"
_SMALL = "(?:(?:" + "|".join(PARTICLES) + ") )*+"
_NAME = rf"(?!{_TITLE}(?!\w))\p{{Lu}}(?:\p{{L}}+|['’]\p{{Lu}}\p{{L}}+)(?:['’-]\p{{L}}{{2,}})*+"
#: Type and pattern, in order of precedence. What repeats without bound is a class of characters, on which no stack grows.
PATTERNS = (
    ("email", r"(?<![\p{L}\w.%+-])[\p{L}\w.%+-]+@[\p{L}0-9-][\p{L}0-9.-]*\.\p{L}{2,}"),
    ("key", r"(?<![\w-])(?:A[KS]IA[0-9A-Z]{16}|AIza[\w-]{35}|gh[opsu]_[0-9A-Za-z]{36,}|xox[abprs]-[0-9A-Za-z-]{10,}|hf_[0-9A-Za-z]{30,}|[prs]k[_-](?:live_|test_|proj-)?[0-9A-Za-z]{20,}|[prs]k[_-](?=[a-z_-]*[0-9A-Z])(?=[A-Za-z_-]*\d)[0-9A-Za-z][0-9A-Za-z_-]{23,}|eyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]{10,})(?![\w-])"),
    ("iban", r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    ("phone", r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,3}(?!\w)|(?<![\w+.-])(?:\(\d{3}\) ?\d{3}[ .-]|\d{3}-\d{3}-|\d{3}\.\d{3}\.)\d{4}(?![\w-]|\.\d)"),
    ("secret", r"(?<![\w])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?!\w)"),
    ("ip6", r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[A-Fa-f:]*\d)(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:]|\.\d)"),
    ("ip", r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)"),
    ("card", r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?!\w)"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
)
NUMBERS = "|".join(p for _, p in PATTERNS)
TITLED = rf"(?<!\w){_TITLE}\.? {_SMALL}{_NAME}(?: {_SMALL}{_NAME})?"
ANY = f"{NUMBERS}|{TITLED}"
#: A text without any of this holds no entity; one quick look.
HINT = rf"[0-9@]|(?:[prs]k|gh[opsu])[_-]|xox|eyJ|hf_|A[KS]IA|AIza|{_TITLE}\.? "
#: What a key starts with, which its surrogate keeps.
KEY_START = r"^(A[KS]IA|AIza|hf_|gh[opsu]_|xox[abprs]-|[prs]k[_-](?:live_|test_|proj-|ant-(?:api\d\d-)?)?|eyJ)"


def type_of(raw: Column) -> Column:
    """The type of a place; what is none of the others is a person."""
    return reduce(lambda rest, x: F.when(raw.rlike(f"^(?:{x[1]})$"), F.lit(x[0])).otherwise(rest), reversed(PATTERNS), F.lit("person"))


def canonical(kind: Column, raw: Column) -> Column:
    """Equal for texts that mean the same entity; names are folded by way of upper case (in an array, as Spark would simplify
    the lower case of an upper case to the former alone). A bar ends what a surrogate keeps: country code, issuer, start or script."""
    script = F.when(raw.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(raw.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")
    code = F.when(raw.startswith("+"), F.regexp_extract(raw, r"^\+(\d{1,3}?)(?=[ .(-]|\d{8,})", 1)).otherwise("1")
    digits = F.regexp_replace(raw, "[^0-9]", "")
    issuer = F.when(F.length(digits) >= 15, 6).otherwise(4)
    plain = F.upper(F.regexp_replace(raw, " ", ""))
    start = F.regexp_extract(raw, KEY_START, 1)
    rest = lambda c, n: F.substring(c, n + 1, F.length(c))
    return (
        F.when(kind == "phone", F.concat(code, F.lit("|"), F.when(raw.startswith("+"), rest(digits, F.length(code))).otherwise(digits)))
        .when(kind == "card", F.concat(F.substring(digits, F.lit(1), issuer), F.lit("|"), rest(digits, issuer)))
        .when(kind == "iban", F.concat(F.substring(plain, 1, 2), F.lit("|"), F.substring(plain, 3, 40)))
        .when(kind == "key", F.concat(start, F.lit("|"), rest(raw, F.length(start))))
        .when(kind == "ssn", digits)
        .when(kind == "person", F.concat(script, F.lit("|"), F.lower(F.array_join(F.array(F.upper(raw)), ""))))
        .otherwise(F.lower(raw))
    )


def _bytes(stream: Column, i: Column) -> Column:
    """A number below 65,536 from place ``i`` of a digest of 512 hexadecimal digits."""
    return F.conv(F.substring(stream, (i % 127) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _pick(values, number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), number % len(values) + 1)


def _luhn(chars: Column) -> Column:
    """Luhn sum of an array of digits, the last of which is not doubled."""
    doubled = F.transform(F.reverse(chars), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int") + 1)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)


def _mod_97(chars: Column) -> Column:
    """The remainder by 97 of digits and letters, the latter read as 10 to 35."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(chars, F.lit(0), lambda a, c: F.pmod(a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c), F.lit(97)).cast("int"))


def surrogate(kind: Column, canon: Column, style: Column, attempt: int, key: str = KEY) -> Column:
    """The surrogate of a canonical entity, in canonical form and without the part before a bar."""
    seed = F.concat(F.lit(f"{key}:{attempt}:"), kind, F.lit(":"), canon)
    stream = F.concat(*(F.sha2(F.concat(seed, F.lit(f":{i}")), 256) for i in range(8)))
    kept, body = F.substring_index(canon, "|", 1), F.substring_index(canon, "|", -1)
    more = max(0, attempt - SAME_LENGTH + 1)
    chars = F.split(body, "")

    def one(s: Column, c: Column, i: Column) -> Column:
        """A character of the class of ``c``."""
        number = _bytes(s, i)
        cyrillic = F.substring(F.lit("абвгдежзиклмнопрстуфхцчшэюя"), number % 27 + 1, F.lit(1))
        letter = F.char(number % 26 + F.when(c.rlike(r"\p{Lu}"), 65).otherwise(97))
        hexadecimal = F.substring(F.lit("0123456789abcdef"), number % 16 + 1, F.lit(1))
        return (
            F.when(kind.isin("secret", "ip6") & c.rlike("[0-9a-f]"), hexadecimal)
            .when(c.rlike("[0-9]"), (number % 10).cast("string"))
            .when(c.rlike(r"\p{IsCyrillic}"), cyrillic)
            .when(c.rlike(r"\p{L}"), letter)
            .otherwise(c)
        )

    def extra(s: Column, like: str) -> Column:
        return F.concat(*(one(s, F.lit(like), F.lit(120 - j)) for j in range(more))) if more else F.lit("")

    def email(s: Column) -> Column:
        end = F.length(F.substring_index(body, ".", -1))
        head = F.substring(body, F.lit(1), F.length(body) - end)
        return F.concat(extra(s, "a"), F.array_join(F.transform(F.split(head, ""), lambda c, i: one(s, c, i)), ""), F.right(body, end))

    def digits(s: Column) -> Column:
        return F.concat(F.array_join(F.transform(chars, lambda c, i: one(s, c, i)), ""), extra(s, "1"))

    def card(s: Column) -> Column:
        """The last digit makes the Luhn remainder of the whole number what it was."""
        start = F.concat(F.array_join(F.transform(F.slice(chars, F.lit(1), F.length(body) - 1), lambda c, i: one(s, c, i)), ""), extra(s, "1"))
        last = F.pmod(_luhn(F.split(F.concat(kept, body), "")) - _luhn(F.split(F.concat(kept, start, F.lit("0")), "")), F.lit(10))
        return F.concat(start, last.cast("string"))

    def iban(s: Column) -> Column:
        account = F.concat(F.array_join(F.transform(F.slice(chars, F.lit(3), F.length(body)), lambda c, i: one(s, c, i)), ""), extra(s, "1"))
        check = 98 - _mod_97(F.split(F.concat(account, kept, F.lit("00")), ""))
        return F.concat(F.lpad(check.cast("string"), 2, "0"), account)

    def address(s: Column) -> Column:
        """Further attempts leave the octets' range, where no real address is."""
        octet = lambda i: _bytes(s, F.lit(i)) % (10 ** (2 + more) if more else 254) + (256 if more else 1)
        return F.concat_ws(".", *(octet(i).cast("string") for i in range(4)))

    def hextets(s: Column) -> Column:
        """The first group stays."""
        first = F.length(F.substring_index(body, ":", 1))
        return F.concat(F.substring(body, F.lit(1), first), F.array_join(F.transform(F.slice(chars, first + 1, F.length(body)), lambda c, i: one(s, c, i)), ""), extra(s, "1"))

    def word(s: Column) -> Column:
        """A given name of the list at first, then made-up ones with an ending of the gender; else a made-up family name."""
        made = {}
        for script, endings in (("latin", {"m": "n", "f": "a", "n": "e"}), ("cyrillic", {"m": "н", "f": "а", "n": "е"}), ("greek", {"m": "ς", "f": "α", "n": "ε"})):
            family = F.concat(*(_pick(SYLLABLES[script], _bytes(s, F.lit(i))) for i in range(1, 4 + attempt)))
            given = reduce(lambda rest, g: F.when(style == f"given-{g}", F.concat(family, F.lit(endings[g])) if attempt else F.lower(_pick(GIVEN[g, script], _bytes(s, F.lit(0))))).otherwise(rest), "mfn", family)
            made[script] = given
        return F.when(kept == "cyrillic", made["cyrillic"]).when(kept == "greek", made["greek"]).otherwise(made["latin"])

    makers = {"email": email, "card": card, "iban": iban, "ip": address, "ip6": hextets, "person": word}
    return common.let(stream, lambda s: reduce(lambda rest, x: F.when(kind == x[0], x[1](s)).otherwise(rest), makers.items(), digits(s)))


def laid_out(kind: Column, raw: Column, made: Column) -> Column:
    """``made`` in the layout of ``raw``: its marks and its case. What ``made`` is longer goes before an e-mail address and
    after all else."""

    def refill(raw: Column, made: Column) -> Column:
        step = lambda acc, c: F.when(
            c.rlike(r"[0-9\p{L}]"),
            F.struct(F.concat(acc["out"], F.when(c.rlike(r"\p{Lu}"), F.upper(F.substring(made, acc["n"], F.lit(1)))).otherwise(F.substring(made, acc["n"], F.lit(1)))).alias("out"), (acc["n"] + 1).alias("n")),
        ).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["n"].alias("n")))
        start = F.struct(F.lit("").alias("out"), F.lit(1).alias("n"))
        filled = F.aggregate(F.split(raw, ""), start, step)
        return F.concat(filled["out"], F.substring(made, filled["n"], F.length(made)))

    bare = F.regexp_replace(made, r"[^0-9\p{L}]", "")
    after = lambda n: F.substring(raw, n + 1, F.length(raw))
    kept = F.when(kind == "phone", F.length(F.regexp_extract(raw, r"^\+\d{1,3}?(?=[ .(-]|\d{8,})", 0))).when(kind == "iban", 2)
    kept = kept.when(kind == "key", F.length(F.regexp_extract(raw, KEY_START, 1)))
    digits = F.regexp_replace(raw, "[^0-9]", "")
    issuer = F.when(F.length(digits) >= 15, 6).otherwise(4)
    longer = F.greatest(F.length(bare) - F.length(F.regexp_replace(raw, r"[^0-9\p{L}]", "")), F.lit(0))
    upper = (F.length(raw) > 1) & (raw == F.upper(raw))
    return (
        F.when(kind == "ip", made)
        .when((kind == "person") & raw.isin(*PARTICLES), raw)
        .when(kind == "person", F.when(upper, F.upper(made)).otherwise(F.initcap(made)))
        .when(kind == "key", F.concat(F.substring(raw, F.lit(1), kept), made))
        .when(kind.isin("phone", "iban"), F.concat(F.substring(raw, F.lit(1), kept), refill(after(kept), bare)))
        .when(kind == "card", refill(raw, F.concat(F.substring(digits, F.lit(1), issuer), bare)))
        .when(kind == "email", F.concat(F.substring(bare, F.lit(1), longer), refill(raw, F.substring(bare, longer + 1, F.length(bare)))))
        .when((kind == "secret") & upper, F.upper(bare))
        .when(kind == "secret", bare)
        .otherwise(refill(raw, bare))
    )


def surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, canon, made) for ``entities(kind, canon)``, distinct: no two entities of a kind share ``made``, and none has
    the canonical form of another entity of its kind. A third column style says what words of names are: given-m,
    given-f, given-n or family; without it all are family names.

    Every attempt takes at least one entity of those that want the same surrogate, unless it is a real one; from
    ``SAME_LENGTH`` on each is a character longer, where ever fewer are taken or real, so the attempts come to an end."""
    style = F.col("style") if "style" in entities.columns else F.lit("family")
    entities = common.stored(entities.select("kind", "canon", style.alias("style")).distinct(), "entities")
    real = entities.select("kind", F.substring_index("canon", "|", -1).alias("made"))
    pending, fixed, attempt = entities, None, 0
    while True:
        tried = pending.withColumn("made", surrogate(F.col("kind"), F.col("canon"), F.col("style"), attempt, key))
        first = tried.groupBy("kind", "made").agg(F.min("canon").alias("canon")).join(real, ["kind", "made"], "left_anti")
        if fixed is not None:
            first = first.join(fixed, ["kind", "made"], "left_anti")
        done = common.stored(first.select("kind", "canon", "made"), "surrogates")
        fixed = done if fixed is None else fixed.union(done)
        pending = common.stored(pending.join(done, ["kind", "canon"], "left_anti"), "entities-left")
        if pending.isEmpty():
            return fixed
        attempt += 1


def _names(raws: Column) -> Column:
    """The titled mentions among ``raws`` as structs: gender of the title and the words of the name but for the small ones."""
    title = lambda r: F.regexp_extract(r, f"^({_TITLE})", 1)
    gender = lambda r: F.when(title(r).isin(*TITLES["m"]), "m").when(title(r).isin(*TITLES["f"]), "f").otherwise("n")
    titled = F.filter(raws, lambda r: r.rlike(rf"^{_TITLE}\.? {_SMALL}\p{{Lu}}"))
    words = lambda r: F.filter(F.split(F.regexp_replace(r, rf"^{_TITLE}\.? ", ""), " "), lambda w: ~w.isin(*PARTICLES))
    return F.transform(titled, lambda r: F.struct(gender(r).alias("gender"), words(r).alias("words")))


def _pattern(names: Column) -> Column:
    """The pattern of a text: numbers of all kinds, and runs of the words known from its titled mentions."""
    words = F.array_distinct(F.flatten(F.transform(names, lambda n: n["words"])))
    words = F.array_distinct(F.flatten(F.array(words, F.transform(words, F.upper), F.transform(words, F.initcap))))
    known = F.concat(F.lit("(?:"), F.array_join(F.transform(words, lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E"))), "|"), F.lit(r")(?![\p{L}\d_])(?!['’-]\p{L}{2})"))
    runs = F.concat(F.lit(NUMBERS + r"|(?<![\p{L}\d_'’-])(?=\p{Lu})"), known, F.lit(f"(?: {_SMALL}"), known, F.lit(")*+"))
    return F.when(F.size(words) > 0, runs).otherwise(F.lit(NUMBERS))


def _entities(words: DataFrame, found: DataFrame) -> DataFrame:
    """(kind, canon, style) of ``found(kind, canon)``; ``words(gender, at, n, word)`` are those of the titled mentions."""
    counts = words.groupBy(canonical(F.lit("person"), F.col("word")).alias("canon")).agg(
        F.count_if((F.col("n") > 1) & (F.col("at") == 0)).alias("first"), F.count("*").alias("all"), F.count_if(F.col("gender") == "m").alias("m"), F.count_if(F.col("gender") == "f").alias("f")
    )
    gender = F.when(F.col("m") > F.col("f"), "m").when(F.col("f") > F.col("m"), "f").otherwise("n")
    style = F.when(2 * F.col("first") > F.col("all"), F.concat(F.lit("given-"), gender)).otherwise("family")
    styles = counts.select(F.lit("person").alias("kind"), "canon", style.alias("style"))
    return found.select("kind", "canon").distinct().join(styles, ["kind", "canon"], "left").select("kind", "canon", F.coalesce("style", F.lit("family")).alias("style"))


def replace(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = KEY) -> DataFrame:
    """Each row of ``docs`` as (row, text, n_entities, kinds); row is a struct of its other columns.

    Texts without entities, null and empty ones come back as they are, with no entities. A run of words of a name counts
    as one entity. Rows that repeat id and text get the same text; key and corpus alone decide, so reruns agree. Types
    that the corpus fills densely get longer surrogates. An empty table gives an empty result."""
    text = F.col("text")
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns if c != text_col) or F.lit(0).alias("none")).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    none = F.array().cast("array<string>")
    rows = common.stored(rows.withColumn("raws", F.coalesce(F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))), none)), "scanned")
    clean = rows.where("size(raws) = 0").select("row", "text", F.lit(0).cast("long").alias("n_entities"), none.alias("kinds"))
    dirty = rows.where("size(raws) > 0").select("row", "text", *common.row_key(F.col("id"), text), _pattern(_names(F.col("raws"))).alias("pattern"))
    words = rows.where("size(raws) > 0").select(F.explode(_names(F.col("raws"))).alias("x")).select("x.gender", F.size("x.words").alias("n"), F.posexplode("x.words").alias("at", "word"))
    found = dirty.select("row_a", "row_b", F.posexplode(F.regexp_extract_all("text", F.col("pattern"), F.lit(0))).alias("at", "raw")).withColumn("kind", type_of(F.col("raw")))
    found = found.select("row_a", "row_b", "at", "kind", F.posexplode(F.when(F.col("kind") == "person", F.split("raw", " ")).otherwise(F.array("raw"))).alias("word", "raw"))
    found = common.stored(found.withColumn("canon", canonical(F.col("kind"), F.col("raw"))), "entity-places")
    placed = found.join(surrogates(_entities(words, found), key), ["kind", "canon"]).select("row_a", "row_b", "at", "word", "kind", laid_out(F.col("kind"), F.col("raw"), F.col("made")).alias("new"))
    placed = placed.groupBy("row_a", "row_b").agg(F.sort_array(F.collect_set(F.struct("at", "word", "new", "kind"))).alias("places"))
    new = common.let(
        F.split(text, F.col("pattern")),
        lambda gaps: F.concat(
            F.array_join(F.transform("places", lambda p: F.concat(F.when(p["word"] == 0, F.get(gaps, p["at"])).otherwise(" "), p["new"])), ""), F.element_at(gaps, -1)
        ),
    )
    # a name that goes on in digits, say, is no place; then the text stays
    some = lambda value, otherwise: F.when(F.col("places").isNull(), otherwise).otherwise(value)
    changed = dirty.join(placed, ["row_a", "row_b"], "left").select(
        "row",
        some(new, text).alias("text"),
        some(F.element_at("places", -1)["at"] + 1, F.lit(0)).cast("long").alias("n_entities"),
        some(F.array_sort(F.array_distinct("places.kind")), none).alias("kinds"),
    )
    return clean.union(changed)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: all documents with surrogates for their entities."""
    found = replace(common.table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "text", "n_entities", "kinds")
