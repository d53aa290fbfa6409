"""Pseudonyms of personal data by format-preserving Feistel permutations (native: DataFrame functions only).

Numbers and dates are found by pattern, validated, and permuted by a keyed Feistel network within their format, so that
equal values stay equal in all documents and different ones different, without a table of values:

* card numbers (13 to 19 digits, Luhn): the digits between the first and the check digit; a new check digit
* telephone numbers (with a country code, or ten digits in the usual groups): the last eight digits
* social security numbers (ddd-dd-dddd): all nine digits
* IPv4 addresses (octets up to 255): all 32 bits
* dates from 1900 to 2099 (y-m-d, y/m/d, m/d/y, d.m.y; existing days): the day's number

Mail addresses (the part before the @) and secrets (access keys, long hexadecimal tokens of either case, values of password= and
the like), of any length, are permuted too: a Feistel network over their characters shifts letters among the letters of
their case, digits among digits (in a hexadecimal token: among the sixteen), by a keyed stream from the other half.
Telephone and card numbers end before a space and another value; of groups of digits that fail as a card, the longest run
of whole groups that is a valid one is replaced. What else fails its validation stays as it is. A pseudonym can equal its value
by chance, as with any permutation; then it isn't counted as replaced.

The key comes from the session's `spark.strandloom.pii.key`, or the argument. Without one, a local master (tests) has a key
that is no secret; on a cluster one is drawn at random and kept in the session's setting, so that pseudonyms are equal in all
documents and queries of the session, but not in other sessions.

Edge cases: a null text stays null with 0 replaced, an empty one empty; equal values in one text are replaced alike;
a null doc_id is kept; repeated rows are treated each; texts of any length are whole; an empty table gives no rows;
`pseudonymise` keeps all other columns, whatever their names, and adds one, whose name the caller chooses.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, unused

TEST_KEY, KEY_SETTING, ROUNDS = "strandloom", "spark.strandloom.pii.key", 8
#: Days from 1900-01-01 to 2099-12-31, 17 * 4297.
DAYS, DAY_LEFT, DAY_RIGHT = 73049, 17, 4297

#: Each takes its first character before it looks back, so that most places fail at once.
#: A part of a host's name, and those that it can't and can end with. Repeated possessively, as Java goes a level deeper for each
#: other repetition of a group, which ends the JVM on long names; a name goes up to its last part that it can end with.
PART = r"[A-Za-z0-9-]++"
INNER, LAST = rf"(?:\.(?![A-Za-z]{{2}}){PART})*+", r"\.(?=[A-Za-z]{2})"
HOST = rf"{PART}(?:{INNER}{LAST}{PART}(?={INNER}{LAST}))*+{INNER}\.[A-Za-z]{{2,24}}"
MAIL = rf"[A-Za-z0-9](?<![A-Za-z0-9._%+-].)[A-Za-z0-9._%+-]*+@{HOST}"
NAMED = "password|passwd|secret|token|api_key"
SECRET = r"AKIA(?<![A-Za-z0-9]....)[0-9A-Z]{16}(?![A-Za-z0-9])|[0-9a-f](?<![A-Za-z0-9].)[0-9a-f]{31,}+(?![A-Za-z0-9])|[0-9A-F](?<![A-Za-z0-9].)[0-9A-F]{31,}+(?![A-Za-z0-9])|[A-Za-z0-9](?<=(?:" + NAMED + r")=.)[^\s\"'<>&;,()]{7,}+"
DATE = r"[0-9](?<![0-9./-].)(?:(?<=1)9[0-9]{2}(?:-[0-9]{2}-|/[0-9]{2}/)[0-9]{2}|(?<=2)0[0-9]{2}(?:-[0-9]{2}-|/[0-9]{2}/)[0-9]{2}|[0-9](?:/[0-9]{2}/|\.[0-9]{2}\.)(?:19|20)[0-9]{2})(?![0-9/-])"
ADDRESS = r"[0-9](?<![0-9.].)[0-9]{0,2}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
SOCIAL = r"[0-9](?<![0-9-].)[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9-])"
#: A space before a value of its own, which a telephone or card number does not run into.
OTHER = r"(?! (?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])|[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])|(?:19|20)[0-9]{2}[-/][0-9]{2}[-/][0-9]{2}(?![0-9])|[0-9]{2}[/.][0-9]{2}[/.](?:19|20)[0-9]{2}(?![0-9])|(?:[2-9][0-9]{2}[.-]|\([2-9][0-9]{2}\) ?)[0-9]{3}[.-][0-9]{4}(?![0-9])|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,4}(?![0-9])))"
GROUP = r"[ .-]?(?:\([0-9]{1,4}\)|[0-9]{2,4})"
PHONE = rf"\+(?<![0-9+].)[0-9]{{1,3}}{GROUP}(?:{OTHER}{GROUP}){{1,4}}(?![0-9])|" r"\((?<![0-9].)[2-9][0-9]{2}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|[2-9](?<![0-9].)[0-9]{2}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
CARD_OTHER = OTHER[: OTHER.rindex("|[0-9]{4}[ -]")] + "))"  # a card's own groups are no other value
CARD = rf"[0-9](?<![0-9].)(?:{CARD_OTHER}[ -]?[0-9]){{12,18}}(?![0-9])"
#: The form of a date that DATE has found.
DATE_FORM = r"[0-9]{4}([-/])[0-9]{2}\1[0-9]{2}|[0-9]{2}([./])[0-9]{2}\2[0-9]{4}"
#: Earlier ones win where several match at a place.
KINDS = (MAIL, SECRET, DATE, ADDRESS, SOCIAL, PHONE, CARD)
ANY = "|".join(KINDS)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: inside a higher-order function each mention would be computed anew."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def digest(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 256)


def feistel(left: Column, right: Column, n_left: Column, n_right: Column, tag: str, key: str = TEST_KEY) -> Column:
    """struct(left, right) after ROUNDS rounds; left < n_left and right < n_right stay so. Each round adds a keyed
    function of one half to the other, so the whole is a permutation."""

    def step(acc: Column, i: Column) -> Column:
        odd = i % 2 == 1
        source = F.when(odd, acc["l"]).otherwise(acc["r"])
        noise = F.conv(F.substring(digest(key, tag, n_left, n_right, i, source), 1, 15), 16, 10).cast("long")
        return F.struct(F.when(odd, acc["l"]).otherwise((acc["l"] + noise) % n_left).alias("l"), F.when(odd, (acc["r"] + noise) % n_right).otherwise(acc["r"]).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def permuted_digits(digits: Column, tag: str, key: str = TEST_KEY) -> Column:
    """Digits (2 to 30 of them) permuted among the strings of as many digits."""
    half = F.floor(F.length(digits) / 2).cast("int")
    rest = F.length(digits) - half
    n_left, n_right = (F.rpad(F.lit("1"), n + 1, "0").cast("long") for n in (half, rest))
    out = feistel(F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, rest), n_left, n_right, tag, key)
    return let(out, lambda o: F.concat(F.lpad(o["l"].cast("string"), half, "0"), F.lpad(o["r"].cast("string"), rest, "0")))


def put_back(value: Column, digits: Column) -> Column:
    """value with its digits replaced one after the other."""
    return let(digits, lambda d: F.array_join(F.transform(F.split(value, "[0-9]", -1), lambda between, i: F.concat(between, F.substring(d, i + 1, F.lit(1)))), ""))


def luhn_sum(digits: Column) -> Column:
    """Luhn's sum; a number is valid if it ends in 0."""

    def step(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step)


def card(value: Column, key: str = TEST_KEY) -> Column:
    def checked(body: Column) -> Column:
        check = (10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
        return put_back(value, F.concat(body, check.cast("string")))

    def new(digits: Column) -> Column:
        middle = permuted_digits(F.substring(digits, F.lit(2), F.length(digits) - 2), "card", key)
        return F.when(luhn_sum(digits) % 10 == 0, let(F.concat(F.substring(digits, 1, 1), middle), checked)).otherwise(value)

    return let(F.regexp_replace(value, "[^0-9]", ""), new)


def card_within(value: Column, key: str = TEST_KEY) -> Column:
    """value with its card number replaced: all of it, or the longest run of whole groups that is valid."""

    def spans(groups: Column) -> Column:
        n = F.size(groups)
        before = lambda i: F.length(F.array_join(F.slice(groups, F.lit(1), i - 1), " ")) + F.when(i > 1, 1).otherwise(0)
        span = lambda i, j: F.struct(F.length(F.array_join(F.slice(groups, i, j - i + 1), "")).alias("digits"), (-i).alias("i"), (before(i) + 1).alias("start"), F.length(F.array_join(F.slice(groups, i, j - i + 1), " ")).alias("n"))
        return F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(i, n), lambda j: span(i, j))))

    part = lambda s: F.substring(value, s["start"], s["n"])
    valid = F.filter(spans(F.split(value, "[ -]")), lambda s: (s["digits"] >= 13) & (luhn_sum(F.regexp_replace(part(s), "[^0-9]", "")) % 10 == 0))
    put = lambda s: F.concat(F.substring(value, F.lit(1), s["start"] - 1), card(part(s), key), F.substring(value, s["start"] + s["n"], F.length(value)))
    return F.coalesce(let(F.array_max(valid), put), value)


def phone(value: Column, key: str = TEST_KEY) -> Column:
    def new(digits: Column) -> Column:
        n = F.length(digits)
        moved = F.concat(F.substring(digits, F.lit(1), n - 8), permuted_digits(F.substring(digits, n - 7, F.lit(8)), "phone", key))
        return F.when(n.between(9, 15), put_back(value, moved)).otherwise(value)

    return let(F.regexp_replace(value, "[^0-9]", ""), new)


def social(value: Column, key: str = TEST_KEY) -> Column:
    return put_back(value, permuted_digits(F.regexp_replace(value, "-", ""), "social", key))


def address(value: Column, key: str = TEST_KEY) -> Column:
    o = [F.split_part(value, F.lit("."), F.lit(i)).cast("int") for i in range(1, 5)]
    out = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), "address", key)
    new = let(out, lambda p: F.concat_ws(".", *[x.cast("string") for h in ("l", "r") for x in (F.floor(p[h] / 256).cast("int"), (p[h] % 256).cast("int"))]))
    return F.when((F.greatest(*o) <= 255) & ~value.rlike(r"(^|\.)0[0-9]"), new).otherwise(value)


def date(value: Column, key: str = TEST_KEY) -> Column:
    def moved(pattern: str, layout: str) -> tuple[Column, Column]:
        day = F.try_to_timestamp(value, F.lit(layout)).cast("date")
        number = F.datediff(day, F.lit("1900-01-01").cast("date"))
        out = feistel(F.floor(number / DAY_RIGHT), number % DAY_RIGHT, F.lit(DAY_LEFT), F.lit(DAY_RIGHT), "date", key)
        new = let(out, lambda o: F.date_add(F.lit("1900-01-01").cast("date"), (o["l"] * DAY_RIGHT + o["r"]).cast("int")))
        return value.rlike(pattern) & number.between(0, DAYS - 1), F.date_format(new, layout)

    cases = [moved("^[0-9]{4}-", "yyyy-MM-dd"), moved("^[0-9]{4}/", "yyyy/MM/dd"), moved("^[0-9]{2}/", "MM/dd/yyyy"), moved(r"^[0-9]{2}\.", "dd.MM.yyyy")]
    return reduce(lambda rest, c: F.when(c[0], c[1]).otherwise(rest), reversed(cases), value)


def shifted(characters: Column, hexadecimal: Column, stream: Callable[[Column], Column]) -> Column:
    """An array of characters, each moved within its class by four hexadecimal digits of the stream (its i-th digest serves
    16 characters)."""
    digests = F.transform(F.sequence(F.lit(0), F.floor(F.size(characters) / 16).cast("int")), stream)

    def one(c: Column, noise: Column) -> Column:
        among = lambda first, size: F.char(F.lit(first) + (F.ascii(c) - first + noise) % size)
        sixteen = lambda letters: F.substring(F.lit(letters), (F.instr(F.lit(letters), c) - 1 + noise).cast("int") % 16 + 1, F.lit(1))
        plain = F.when(c.between("a", "z"), among(97, 26)).when(c.between("A", "Z"), among(65, 26)).when(c.between("0", "9"), among(48, 10)).otherwise(c)
        return F.when(hexadecimal == 1, sixteen("0123456789abcdef")).when(hexadecimal == 2, sixteen("0123456789ABCDEF")).otherwise(plain)

    digits = lambda d, i: F.substring(F.get(d, F.floor(i / 16).cast("int")), 4 * (i % 16) + 1, F.lit(4))
    return let(digests, lambda d: F.transform(characters, lambda c, i: let(F.conv(digits(d, i), 16, 10).cast("int"), lambda noise: one(c, noise))))


def permuted_text(value: Column, tag: str | Column, key: str = TEST_KEY, hexadecimal: Column | None = None) -> Column:
    """value with its letters and digits permuted within their classes, or, where hexadecimal is true and it has one case only,
    among the sixteen of that case."""
    kind = F.lit(0) if hexadecimal is None else F.when(hexadecimal & value.rlike("^[0-9a-f]+$"), 1).when(hexadecimal & value.rlike("^[0-9A-F]+$"), 2).otherwise(0)
    join = lambda a: F.array_join(a, "")

    def whole(given: Column) -> Column:
        characters, how = given["characters"], given["kind"]
        half = F.floor(F.size(characters) / 2).cast("int")

        def step(acc: Column, i: Column) -> Column:
            odd = i % 2 == 1
            moved = shifted(F.when(odd, acc["r"]).otherwise(acc["l"]), how, lambda j: digest(key, tag, i, j, join(F.when(odd, acc["l"]).otherwise(acc["r"]))))
            return let(moved, lambda m: F.struct(F.when(odd, acc["l"]).otherwise(m).alias("l"), F.when(odd, m).otherwise(acc["r"]).alias("r")))

        start = F.struct(F.slice(characters, F.lit(1), half).alias("l"), F.slice(characters, half + 1, F.size(characters)).alias("r"))
        return let(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS // 2 - 1)), start, step), lambda o: F.concat(join(o["l"]), join(o["r"])))

    return let(F.struct(F.split(value, "(?!^)(?!$)").alias("characters"), kind.alias("kind")), whole)


def private_text(value: Column, key: str = TEST_KEY) -> Column:
    """A mail address with the part before the @ replaced, an access key with what follows its four letters, another secret whole."""
    at, access = value.contains("@"), value.startswith("AKIA") & (F.length(value) == 20)
    part = lambda a, b, c: F.struct(a.alias("before"), b.alias("own"), c.alias("after"))
    none = F.lit("")
    cut = F.when(at, part(none, F.substring_index(value, "@", 1), F.concat(F.lit("@"), F.substring_index(value, "@", -1)))).when(access, part(F.lit("AKIA"), F.substring(value, F.lit(5), F.lit(16)), none)).otherwise(part(none, value, none))
    tag = F.when(at, "mail").when(access, "key").otherwise("secret")
    return let(cut, lambda p: F.concat(p["before"], permuted_text(p["own"], tag, key, ~at & ~access), p["after"]))


def pseudonym(value: Column, key: str = TEST_KEY) -> Column:
    """The pseudonym of one match."""
    whole = lambda kind: value.rlike(f"^(?:{kind})$")
    shape = [(whole(DATE_FORM), date(value, key)), (whole(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"), address(value, key)), (whole(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), social(value, key)), (whole(r"[0-9](?:[ -]?[0-9]){12,18}"), card_within(value, key)), (whole(r"[0-9+(][0-9 ().-]*"), phone(value, key))]
    return reduce(lambda rest, c: F.when(c[0], c[1]).otherwise(rest), reversed(shape), private_text(value, key))


def key_of(spark: SparkSession) -> str:
    given = spark.conf.get(KEY_SETTING, None)
    if given:
        return given
    if spark.sparkContext.master.startswith("local"):
        return TEST_KEY
    spark.conf.set(KEY_SETTING, secrets.token_hex(16))
    return spark.conf.get(KEY_SETTING)


def pseudonymise(df: DataFrame, column: str = "text", count: str = "n_replaced", key: str | None = None) -> DataFrame:
    """df with the column's personal data replaced, and how many values were."""
    key = key or key_of(df.sparkSession)
    text, found, new = F.col(f"`{column}`"), unused("found_values", df), unused("new_values", df)
    searched = F.when(text.rlike(f"[0-9@]|(?:{NAMED})="), F.regexp_extract_all(text, F.lit(ANY), 0))
    staged = df.withColumn(found, searched)
    staged = staged.withColumn(new, F.when(F.size(found) > 0, F.transform(found, lambda m: pseudonym(m, key))))
    between = F.split(text, ANY, -1)
    joined = F.array_join(F.transform(F.arrays_zip(between.alias("b"), F.col(new).alias("n")), lambda x: F.concat(x["b"], F.coalesce(x["n"], F.lit("")))), "")
    replaced = F.when(F.size(found) > 0, joined).otherwise(text)
    changed = F.coalesce(F.size(F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda x: x)), F.lit(0))
    names = {c: F.col(f"`{c}`") for c in df.columns} | {column: replaced}
    return staged.select(*[v.alias(k) for k, v in names.items()], F.when(F.size(found) > 0, changed).otherwise(0).alias(count))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
