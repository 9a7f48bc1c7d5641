"""Personal data replaced by keyed surrogates of the same kind and form (operator 4), with SQL functions only.

Found are e-mail addresses, IPv4 addresses, bank cards, phone numbers, US social-security numbers, IBANs, secret
hexadecimal tokens, and names after a title. Each distinct entity (kind and canonical form: letter case and
the separators of numbers do not count) gets one surrogate, drawn from SHA-256 of the key, so the same entity is
the same surrogate in every document (coreference). Digits stay digits, letters letters of their script and case, separators
and top-level domains stay; cards keep their first digit and whether their check digit is right; octets stay octets; phone numbers
keep their country code; names keep the title, the gender it tells, their script and letter case, and a family name
has one surrogate wherever it stands: families are entities of their own, and Mr. and Mrs. X share theirs (Cyrillic ones
take the ending of the gender).

Collisions are checked over the corpus: a surrogate that another entity of its kind has, or that is
itself an entity found, is drawn anew until all differ. Of a full name only the given name is drawn anew. Only documents with findings are shuffled, with
their findings; an entity in a third of all documents is one row of the table of surrogates, and the join with it may split.

Null and empty texts stay as they are; rows that repeat are replaced each, also under a null doc_id;
`replaced` keeps all columns of its input, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanpulse.session import materialise

KEY = "a key of one's own"
ATTEMPTS = 40

FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Mme", "Madame", "Mlle", "Señora", "Señorita", "Sra", "Srta", "г-жа", "госпожа")
MALE_TITLES = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "г-н", "господин")
FEMALE = {"latin": ("Alma", "Bianca", "Clara", "Dora", "Elisa", "Fiona", "Greta", "Helena", "Irene", "Julia", "Karla", "Livia",
                    "Maria", "Nora", "Olivia", "Paula", "Rosa", "Sara", "Teresa", "Vera"),
          "cyrillic": ("Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Юлия")}
MALE = {"latin": ("Adam", "Bruno", "Carlos", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon",
                  "Martin", "Nico", "Oscar", "Paul", "Rafael", "Simon", "Thomas", "Victor"),
        "cyrillic": ("Антон", "Борис", "Глеб", "Денис", "Егор", "Иван", "Максим", "Олег", "Пётр", "Юрий")}
SYLLABLES = {"latin": "ba be bo da de do fa fe ga go ha he ka ke ko la le lo ma me mo na ne no pa pe po ra re ro sa so ta te to va ve vo za zo".split(),
             "cyrillic": "ба бо ва ве го да де жа ка ко ла ле ло ма ме мо на не но па по ра ре ро са со та те то ша".split()}

TITLES = "|".join(sorted(FEMALE_TITLES + MALE_TITLES, key=len, reverse=True))
WORD = r"\p{Lu}[\p{Ll}'’-]++"
PATTERNS = {
    # the local part begins where its characters begin, or the last finding ended, so that a long run is read once
    "email": r"(?:(?<![\p{L}\p{N}._%+-])|\G)[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){0,8}\.\p{L}{2,24}",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "secret": r"(?<![\p{L}\p{N}])(?=[A-Fa-f]*+[0-9])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![\p{L}\p{N}])",
    "ip": r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?![\p{L}\p{N}]|\.[0-9])",
    "card": r"(?<![\p{L}\p{N}])[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])",
    "phone": r"(?<![\p{L}\p{N}])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![\p{L}\p{N}])"
             r"|(?<![\p{L}\p{N}])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![\p{L}\p{N}])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{TITLES})\.? {WORD}(?: {WORD})?",
}
ENTITY = "|".join(PATTERNS.values())
HINT = rf"[0-9@]|(?<![\p{{L}}])(?:{TITLES})[. ]"


def kind_of(found: Column) -> Column:
    """The first kind whose pattern the whole finding matches."""
    plain = {k: p for k, p in PATTERNS.items()}
    return F.coalesce(*[F.when(found.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in plain.items()], F.lit("phone"))


def gender_of(found: Column) -> Column:
    return F.when(found.rlike(f"^(?:{'|'.join(sorted(FEMALE_TITLES, key=len, reverse=True))})[. ]"), "f").otherwise("m")


def canonical(kind: Column, found: Column) -> Column:
    name = F.concat(gender_of(found), F.lit(":"), F.lower(F.regexp_replace(found, rf"^(?:{TITLES})\.? ", "")))
    return (F.when(kind == "name", name).when(kind.isin("email", "ip"), F.lower(found))
            .otherwise(F.lower(F.regexp_replace(found, r"[^\p{L}\p{N}]", ""))))


def digest(*what: Column | str, key: str) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *[w if isinstance(w, Column) else F.lit(w) for w in what]).cast("binary"), 256)


def number(hexed: Column, at: Column, width: int = 4) -> Column:
    return F.conv(F.substring(hexed, at, F.lit(width)), 16, 10).cast("int")


def pick(options, n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), n % len(options) + 1)


def script_of(text: Column) -> Column:
    return F.when(text.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")


def redrawn(kind: Column, canon: Column, stream: Column) -> Column:
    """Every letter and digit drawn anew: decimal, hexadecimal or a letter of its script."""
    chars = F.split(canon, "")
    kept = F.when(kind == "email", F.length(F.regexp_extract(canon, r"\p{L}+$", 0))).otherwise(0)
    country = F.when(kind == "phone", F.greatest(F.length(canon) - 10, F.lit(0))).when(kind == "card", 1).when(kind == "iban", 2).otherwise(0)

    def one(c: Column, i: Column) -> Column:
        n = number(stream, i * 4 + 1)
        letter = lambda alphabet: F.substring(F.lit(alphabet), n % len(alphabet) + 1, F.lit(1))
        return (F.when((i < country) | (i >= F.length(canon) - kept), c)
                .when(c.rlike("[0-9]"), (n % 10).cast("string"))
                .when((kind == "secret") & c.rlike("[a-f]"), letter("abcdef"))
                .when(c.rlike(r"\p{IsCyrillic}"), letter("абвгдежзиклмнопрстуфхцчшэюя"))
                .when(c.rlike(r"\p{IsGreek}"), letter("αβγδεζηθικλμνξοπρστυφχψω"))
                .when(c.rlike(r"[\p{L}\p{N}]"), letter("abcdefghijklmnopqrstuvwxyz"))
                .otherwise(c))

    return F.array_join(F.transform(chars, one), "")


def luhn(digits: Column) -> Column:
    """The check sum modulo 10; 0 for a right check digit."""
    turned = F.split(F.reverse(digits), "")
    parts = F.transform(turned, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(parts, F.lit(0), lambda a, b: a + b) % 10


def words_of(canon: Column) -> Column:
    """Given and family name, or the family name alone, of a canonical name."""
    return F.split(F.substring(canon, F.lit(3), F.length(canon)), " ")


def syllables(script: str, hexed: Column, n: int, skip: int = 0) -> list[Column]:
    return [pick(SYLLABLES[script], number(hexed, F.lit(1 + 4 * (skip + k)))) for k in range(n)]


def family_name(family: Column, key: str, attempt: Column) -> Column:
    """A family name, the male form of a Cyrillic one."""
    own = digest("family", family, attempt, key=key)
    latin, cyrillic = (F.initcap(F.concat(*syllables(script, own, 4))) for script in ("latin", "cyrillic"))
    return F.when(script_of(family) == "latin", latin).otherwise(F.concat(cyrillic, F.lit("ов")))


def of_gender(canon: Column, family: Column) -> Column:
    return F.when(canon.startswith("f:") & (script_of(family) == "cyrillic"), F.concat(family, F.lit("а"))).otherwise(family)


def full_name(canon: Column, family: Column, key: str, attempt: Column) -> Column:
    """A given name before the family's surrogate; later attempts lengthen it, so common families do not run out of them."""
    given, female = F.element_at(words_of(canon), 1), canon.startswith("f:")
    first = F.when(attempt == 0, digest("given", given, key=key)).otherwise(digest("given", canon, attempt.cast("string"), key=key))
    drawn = []
    for script in ("latin", "cyrillic"):
        name = F.when(female, pick(FEMALE[script], number(first, F.lit(1)))).otherwise(pick(MALE[script], number(first, F.lit(1))))
        more = F.slice(F.array(*syllables(script, first, 4, 1)), F.lit(1), F.greatest(F.least(attempt - 1, F.lit(4)), F.lit(0)))
        drawn.append(F.concat(name, F.array_join(more, "")))
    return F.concat(F.when(script_of(given) == "latin", drawn[0]).otherwise(drawn[1]), F.lit(" "), of_gender(canon, family))


def draw(entities: DataFrame, key: str) -> DataFrame:
    """kind, canon, family (the surrogate, of full names), attempt -> surrogate, in canonical form (names: as written)."""
    kind, canon, attempt = F.col("kind"), F.col("canon"), F.col("attempt").cast("string")
    blocks = F.sequence(F.lit(0), F.floor(F.length(canon) / 16).cast("int"))
    stream = F.array_join(F.transform(blocks, lambda k: digest(kind, canon, attempt, k.cast("string"), key=key)), "")
    ip = F.concat_ws(".", *[(number(F.col("stream"), F.lit(1 + 4 * k)) % 254 + 1).cast("string") for k in range(4)])
    last = F.length("drawn")
    # the last digit that keeps the check sum right, or one past it where it was wrong
    head = F.col("drawn").substr(F.lit(1), last - 1)
    right = (10 - luhn(F.concat(head, F.lit("0")))) % 10
    card = F.concat(head, ((right + F.when(luhn(canon) == 0, 0).otherwise(1)) % 10).cast("string"))
    return (entities.withColumn("stream", stream).withColumn("drawn", redrawn(kind, canon, F.col("stream")))
            .withColumn("surrogate", F.when(kind == "ip", ip).when(kind == "card", card)
                        .when(kind == "family", family_name(canon, key, attempt))
                        .when(kind == "name", full_name(canon, F.col("family"), key, F.col("attempt"))).otherwise(F.col("drawn"))).drop("stream", "drawn"))


def surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """kind, canon, surrogate of distinct entities; surrogates of a kind differ from each other and from all its entities,
    but for family names alone, which differ by family."""
    none = F.lit(None).cast("string").alias("family")
    names = entities.where("kind = 'name'").select("kind", "canon", words_of(F.col("canon")).alias("words"))
    names = names.select("kind", "canon", (F.size("words") > 1).alias("full"), F.element_at("words", -1).alias("of"))
    others = entities.where("kind <> 'name'").select("kind", "canon", none)
    families = names.select(F.lit("family").alias("kind"), F.col("of").alias("canon"), none).distinct()
    # no ending of a Cyrillic surrogate may give a family found
    real = others.union(families).select("kind", F.when(
        F.col("kind") == "family", F.regexp_replace("canon", "(?<=ов)а$", "")).otherwise(F.col("canon")).alias("same")).distinct()
    settled = distinct_draws(others.union(families), real, key)
    found = settled.where("kind = 'family'").select(F.col("canon").alias("of"), F.col("surrogate").alias("family"))
    names = materialise(names.join(found, "of").select("kind", "canon", "full", "family"))
    alone = names.where("NOT full").select("kind", "canon", of_gender(F.col("canon"), F.col("family")).alias("surrogate"))
    full = names.where("full").select("kind", "canon", "family")
    real = full.select("kind", F.substring("canon", 3, 1_000).alias("same")).distinct()
    return settled.where("kind <> 'family'").union(alone).union(distinct_draws(full, real, key))


def distinct_draws(entities: DataFrame, real: DataFrame, key: str) -> DataFrame:
    """kind, canon, surrogate of entities (kind, canon, family): drawn anew while two are alike or one is in `real`."""
    settled, open_ = None, entities.withColumn("attempt", F.lit(0))
    for _ in range(ATTEMPTS):
        drawn = draw(open_, key).withColumn("same", F.lower("surrogate"))
        taken = real if settled is None else real.union(settled.select("kind", F.lower("surrogate")))
        first = drawn.groupBy("kind", "same").agg(F.min("canon").alias("first"))
        checked = materialise(
            drawn.join(first, ["kind", "same"]).join(taken.withColumn("taken", F.lit(True)), ["kind", "same"], "left")
            .select("kind", "canon", "family", "attempt", "surrogate", (F.col("taken").isNull() & (F.col("canon") == F.col("first"))).alias("good")))
        good = checked.where("good").select("kind", "canon", "surrogate")
        settled = good if settled is None else settled.union(good)
        rest = checked.where("NOT good")
        if rest.isEmpty():
            return settled
        open_ = rest.select("kind", "canon", "family", (F.col("attempt") + 1).alias("attempt"))
    raise ValueError(f"more entities of a kind than surrogates: {rest.first()}")


def rendered(kind: Column, found: Column, surrogate: Column) -> Column:
    """The surrogate in the form of the finding: its separators and letter case."""
    chars = F.split(found, "")
    alike = F.transform(chars, lambda c, i: F.when((kind == "email") | c.rlike(r"[\p{L}\p{N}]"), 1).otherwise(0))
    rank = lambda i: F.aggregate(F.slice(alike, F.lit(1), i + 1), F.lit(0), lambda a, b: a + b)

    def one(c: Column, i: Column) -> Column:
        new = F.substring(surrogate, rank(i), F.lit(1))
        return F.when(F.element_at(alike, i + 1) == 0, c).when((c == F.upper(c)) & (c != F.lower(c)), F.upper(new)).otherwise(new)

    written = F.array_join(F.transform(chars, one), "")
    title = F.regexp_extract(found, rf"^(?:{TITLES})\.? ", 0)
    shouted = F.when(found == F.upper(found), F.upper(surrogate)).otherwise(surrogate)
    return F.when(kind == "name", F.concat(title, shouted)).when(kind == "ip", surrogate).otherwise(written)


def findings(text: Column) -> Column:
    """All entities of a text in order; texts without a digit, an at sign or a title are passed over."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)))


def with_surrogates(docs: DataFrame, text: str, key: str = KEY) -> DataFrame:
    """The rows of `docs` with column `text` replaced, and n_entities and kinds added. Column names must differ."""
    names = docs.columns
    rows = docs.withColumn("_found", findings(F.col(text)))
    plain = rows.where("_found IS NULL OR size(_found) = 0").drop("_found")
    held = materialise(rows.where("size(_found) > 0").withColumn("_row", F.xxhash64(*names)))
    one = held.select("_row", "_found").groupBy("_row").agg(F.first("_found").alias("_found"))
    seen = one.select("_row", F.posexplode("_found").alias("at", "found"))
    seen = seen.withColumn("kind", kind_of(F.col("found"))).withColumn("canon", canonical(F.col("kind"), F.col("found")))
    seen = materialise(seen)
    table = surrogates(seen.select("kind", "canon").distinct(), key)
    new = seen.join(table, ["kind", "canon"]).select(
        "_row", F.struct("at", rendered(F.col("kind"), F.col("found"), F.col("surrogate")).alias("new"), "kind").alias("hit"))
    lists = new.groupBy("_row").agg(F.array_sort(F.collect_list("hit")).alias("_hits"))
    between = F.split(F.col(text), ENTITY, -1)
    joined = F.array_join(F.transform(between, lambda part, i: F.concat(part, F.coalesce(F.try_element_at(F.col("_hits"), (i + 1).cast("int"))["new"], F.lit("")))), "")
    done = held.join(lists, "_row").select(
        *[joined.alias(c) if c == text else F.col(c) for c in names], F.size("_hits").cast("long").alias("n_entities"),
        F.array_sort(F.array_distinct(F.transform("_hits", lambda h: h["kind"]))).alias("kinds"))
    return plain.select(*names, F.lit(0).cast("long").alias("n_entities"), F.array().cast("array<string>").alias("kinds")).union(done)


def replaced(docs: DataFrame, key: str = KEY) -> DataFrame:
    """All rows and columns of `docs`, entities in the text replaced."""
    own = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = [c.lower() for c in docs.columns].index("text")
    return with_surrogates(own, f"c{at}", key).drop("n_entities", "kinds").toDF(*docs.columns)


def surrogate_texts(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, n_entities, kinds, text (replaced) of every document."""
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return with_surrogates(own, "text", key).select("doc_id", "n_entities", "kinds", "text")
