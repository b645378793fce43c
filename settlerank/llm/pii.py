"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Found in a text and replaced in place:

* card numbers (13-19 digits, also in groups) whose check digit holds: the digits between the first and the check digit
  are permuted and the check digit is set anew. In a run of numbers with single blanks or hyphens between, every sub-run of
  whole groups is tried: single groups first, then the usual groupings, then any other, the longest at each place first;
* phone numbers with a leading ``+`` or a bracketed area code: all digits behind the country code are permuted, in every form of one
  number alike;
* IPv4 addresses with four valid octets: permuted among all addresses;
* dates (``2021-03-04``, ``04/03/2021``, ``04.03.2021`` and the like) that exist, 1800 to 2199: permuted among those
  400 years, written in the same form;
* mail addresses: the letters and digits of the local part become others from a keyed digest, the domain stays.

The permutations are Feistel networks of ``ROUNDS`` rounds with a keyed digest as round function, on pairs of numbers
(a, b) whose ranges multiply to the size of the format, so they map the format onto itself one to one: equal values get equal
pseudonyms in every document and different values different ones. Separators, lengths and forms stay. Numbers that
do not validate are left alone.

A null text stays null and an empty one empty. Rows, also repeated ones and such with null ids, keep all their columns;
only the text is replaced. Texts without a match are passed on unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 8
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .-]?)(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)" \
        r"|(?<!\w)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)"
ADDRESS = r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\w)"
DATE = r"(?<![\w/.-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4}|\d{2}-\d{2}-\d{4})(?![\w/-])"
_NAME = r"[\p{L}\p{N}._%+-]"
_MAIL = _NAME + r"{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,127}[A-Za-z]{2,63}+"
#: Names of up to 64 characters and domains of up to 127 labels, as the standards have it. A name starts where no name character
#: precedes and is never given back, so a long run of letters is read once, and the labels' number bounds the stack.
MAIL = f"(?<!{_NAME})" + _MAIL
#: A run of groups that starts with 13 digits or more and stops before a date, an address or a mail address. Possessive,
#: so that a run of very many groups takes no stack.
CARD = r"(?<![\w.+])(?<!\w-)(?=\d(?:[ -]?\d){12})\d++(?!\w)(?:[ -](?!" + f"{DATE}|{ADDRESS}|{_MAIL}" + r")\d++(?!\w))*+"
#: The country codes of one and of two digits; all others have three.
COUNTRY_CODE = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: Lengths of groups that card numbers are usually written in.
CARD_GROUPS = ((4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3))
ANY = f"{MAIL}|{DATE}|{ADDRESS}|{PHONE}|{CARD}"

#: Days in 400 years of the calendar, as a product for the two halves of the network.
_DAYS = (189, 773)
_FIRST_DAY = "1800-01-01"


def _number(text: Column) -> Column:
    return text.cast("long")


def _round(key: str, tweak: Column, half: Column, at: Column, size: Column) -> Column:
    """A keyed digest of the other half, the round and the format, below ``size``."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, at.cast("string"), half.cast("string"), F.lit(key)), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), size)


def feistel(a: Column, b: Column, size_a: Column, size_b: Column, key: str, tweak: Column) -> Column:
    """Permutes the pairs (a, b) with a < size_a and b < size_b; a struct of the new a and b."""
    def step(state: Column, at: Column) -> Column:
        left = F.pmod(state["a"] + _round(key, tweak, state["b"], at, size_a), size_a)
        right = F.pmod(state["b"] + _round(key, tweak, state["a"], at, size_b), size_b)
        even = at % 2 == 0
        return F.struct(F.when(even, left).otherwise(state["a"]).alias("a"),
                        F.when(even, state["b"]).otherwise(right).alias("b"))
    rounds = F.array(*[F.lit(i).cast("long") for i in range(ROUNDS)])
    return F.aggregate(rounds, F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def permute_digits(digits: Column, key: str, tweak: Column) -> Column:
    """Another string of as many digits (at least 2, at most 36)."""
    n = F.length(digits)
    left, right = F.floor(n / 2).cast("int"), (n - F.floor(n / 2)).cast("int")
    power = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
    new = feistel(_number(F.substring(digits, F.lit(1), left)), _number(F.substring(digits, left + 1, right)),
                  power(left), power(right), key, F.concat(tweak, n.cast("string")))
    pair = F.transform(F.array(new), lambda x: F.concat(F.lpad(x["a"].cast("string"), left, "0"),
                                                        F.lpad(x["b"].cast("string"), right, "0")))
    return F.when(n < 2, digits).otherwise(pair[0])


def luhn_digit(body: Column) -> Column:
    """The check digit that makes ``body`` and it valid: the one of ten that validates."""
    tens = F.array(*[F.lit(str(i)) for i in range(10)])
    return F.filter(tens, lambda d: F.call_function("luhn_check", F.concat(body, d)))[0]


def refill(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced in order by ``digits``."""
    state = F.aggregate(
        F.split(form, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda s, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(s["out"], F.substring(digits, s["at"], F.lit(1))).alias("out"),
                                                         (s["at"] + 1).alias("at")))
        .otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))))
    return F.transform(F.array(state), lambda s: s["out"])[0]


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def card(text: Column, key: str) -> Column:
    def new(digits: Column) -> Column:
        n = F.length(digits)
        body = F.concat(F.substring(digits, 1, 1),
                        permute_digits(F.substring(digits, F.lit(2), n - 2), key, F.lit("card")))
        return _let(body, lambda b: refill(text, F.concat(b, luhn_digit(b))))
    return _let(F.regexp_replace(text, r"\D", ""), lambda d: F.when(F.call_function("luhn_check", d), new(d)).otherwise(text))


def cards(text: Column, key: str) -> Column:
    """A run of digit groups with the valid card numbers in it replaced: struct of the text and of how many were.

    Groups are taken from left to right, three times: a number found earlier is not cut by a later one.
    """
    whole, none = F.array(F.struct(F.split(text, "[ -]").alias("groups"), F.regexp_extract_all(text, F.lit("([ -])"), F.lit(1)).alias("gaps"))), \
        F.array().cast("array<struct<a:int,k:int>>")

    def find(groups: Column, taken: Column, usable) -> Column:
        """``taken`` and the valid spans of k groups from a that ``usable`` lets pass."""
        def step(state: Column, i: Column) -> Column:
            def valid(k: Column) -> Column:
                digits = F.array_join(F.slice(groups, i + 1, k), "")
                free = ~F.exists(state["taken"], lambda s: (s["a"] < i + k) & (s["a"] + s["k"] > i))
                return usable(F.slice(groups, i + 1, k)) & F.length(digits).between(13, 19) & free & F.call_function("luhn_check", digits)
            spans = F.filter(F.sequence(F.lit(1), F.least(F.lit(19), F.size(groups) - i)), valid)
            return F.transform(F.array(spans), lambda ks: F.when(F.size(ks) > 0, F.struct(F.concat(state["taken"], F.array(F.struct(
                i.alias("a"), F.element_at(ks, -1).alias("k")))).alias("taken"))).otherwise(state))[0]
        places = F.sequence(F.lit(0), F.size(groups) - 1)
        return F.aggregate(places, F.struct(taken.alias("taken")), step)["taken"]

    usual = [F.array(*[F.lit(n) for n in lengths]) for lengths in CARD_GROUPS]

    def is_usual(span: Column) -> Column:
        lengths, found = F.transform(span, lambda g: F.length(g)), F.lit(False)
        for one in usual:
            found = found | (lengths == one)
        return found

    def write(groups: Column, gaps: Column, spans: Column) -> Column:
        pieces = F.zip_with(groups, gaps, lambda g, x: F.concat(g, F.coalesce(x, F.lit(""))))

        def step(state: Column, span: Column) -> Column:
            before = F.array_join(F.slice(pieces, state["at"] + 1, span["a"] - state["at"]), "")
            old = F.concat(F.array_join(F.slice(pieces, span["a"] + 1, span["k"] - 1), ""), F.get(groups, span["a"] + span["k"] - 1))
            after = F.coalesce(F.get(gaps, span["a"] + span["k"] - 1), F.lit(""))
            return _let(old, lambda o: _let(card(o, key), lambda new: F.struct(
                F.concat(state["text"], before, new, after).alias("text"), (span["a"] + span["k"]).alias("at"),
                (state["n"] + (o != new).cast("int")).alias("n"))))
        start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"), F.lit(0).alias("n"))
        return _let(F.aggregate(F.array_sort(spans), start, step), lambda s: F.struct(
            F.concat(s["text"], F.array_join(F.slice(pieces, s["at"] + 1, F.size(pieces)), "")).alias("text"), s["n"].alias("n")))

    def new(run: Column) -> Column:
        groups = run["groups"]
        return _let(find(groups, none, lambda span: F.size(span) == 1), lambda one: _let(
            find(groups, one, is_usual), lambda two: _let(find(groups, two, lambda span: F.lit(True)), lambda three: write(
                groups, run["gaps"], three))))
    return F.transform(whole, new)[0]


def phone(text: Column, key: str) -> Column:
    """The country code is told from the digits alone, so every form of one number gets the same digits."""
    def new(digits: Column) -> Column:
        code = F.when(text.startswith("+"), F.regexp_extract(digits, COUNTRY_CODE, 0)).otherwise(F.lit(""))
        return _let(code, lambda c: refill(text, F.concat(c, permute_digits(
            F.substring(digits, F.length(c) + 1, F.length(digits)), key, F.lit("phone")))))
    return _let(F.regexp_replace(text, r"\D", ""), new)


def address(text: Column, key: str) -> Column:
    octet = [_number(x) for x in (F.split(text, r"\.")[i] for i in range(4))]
    size = F.lit(65536).cast("long")
    new = feistel(octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], size, size, key, F.lit("ipv4"))
    return _let(new, lambda x: F.concat_ws(".", F.floor(x["a"] / 256).cast("string"), (x["a"] % 256).cast("string"),
                                           F.floor(x["b"] / 256).cast("string"), (x["b"] % 256).cast("string")))


def date(text: Column, key: str) -> Column:
    """Day first where the first number can be one and both orders are possible; month first where only that exists."""
    year_first = text.rlike(r"^\d{4}")
    digits = F.regexp_replace(text, r"\D", "")
    y = F.when(year_first, F.substring(digits, 1, 4)).otherwise(F.substring(digits, 5, 4))
    one = F.when(year_first, F.substring(digits, 5, 2)).otherwise(F.substring(digits, 1, 2))
    two = F.when(year_first, F.substring(digits, 7, 2)).otherwise(F.substring(digits, 3, 2))
    day_month = F.try_to_timestamp(F.concat_ws("-", y, two, one), F.lit("yyyy-MM-dd")).cast("date")
    month_day = F.try_to_timestamp(F.concat_ws("-", y, one, two), F.lit("yyyy-MM-dd")).cast("date")
    month_first = year_first | day_month.isNull()
    day = F.when(month_first, month_day).otherwise(day_month)
    low, high = (F.lit(x).cast("long") for x in _DAYS)

    def new(at: Column) -> Column:
        moved = feistel(F.floor(at / _DAYS[1]), at % _DAYS[1], low, high, key, F.lit("date"))
        return _let(moved, lambda x: F.date_add(F.lit(_FIRST_DAY).cast("date"), (x["a"] * _DAYS[1] + x["b"]).cast("int")))

    def write(d: Column) -> Column:
        return F.when(year_first, F.date_format(d, "yyyyMMdd")).when(month_first, F.date_format(d, "MMddyyyy")) \
            .otherwise(F.date_format(d, "ddMMyyyy"))

    at = F.datediff(day, F.lit(_FIRST_DAY).cast("date")).cast("long")
    return F.when(day.isNull() | (at < 0) | (at >= _DAYS[0] * _DAYS[1]), text) \
        .otherwise(refill(text, _let(new(at), write)))


def mail(text: Column, key: str) -> Column:
    """Letters and digits of the local part, one by one, from a digest of the whole address; as long as before."""
    local = F.substring_index(text, "@", 1)
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("mail"), F.lower(text), F.lit(key)), 512)
    letters, figures = "abcdefghijklmnopqrstuvwxyz", "0123456789"

    def pick(c: Column, i: Column) -> Column:
        at = F.conv(F.substring(digest, (i * 2) % 126 + 1, F.lit(2)), 16, 10).cast("int")
        return F.when(c.rlike(r"^\d$"), F.substring(F.lit(figures), at % 10 + 1, F.lit(1))) \
            .when(c.rlike(r"^\p{L}$"), F.substring(F.lit(letters), at % 26 + 1, F.lit(1))).otherwise(c)
    new = F.array_join(F.transform(F.split(local, ""), pick), "")
    return F.concat(new, F.substring(text, F.length(local) + 1, F.length(text)))


def pseudonym(match: Column, key: str) -> Column:
    """What stands in for one match (``text``) and how many values it replaces (``n``); what does not validate stands for itself."""
    one = lambda value: _let(value, lambda v: F.struct(v.alias("text"), (v != match).cast("int").alias("n")))
    return F.when(match.contains("@"), one(mail(match, key))) \
        .when(match.rlike(f"^(?:{DATE})$"), one(date(match, key))) \
        .when(match.rlike(f"^(?:{ADDRESS})$"), one(address(match, key))) \
        .when(match.rlike(r"^[+(]"), one(phone(match, key))) \
        .otherwise(cards(match, key))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The rows with every personal value in the text replaced, and ``n_pseudonyms``, how many were. No shuffle.

    A text is cut at the matches; the pieces between them and the stand-ins are put together again in turn. Only texts that
    hold a digit or an ``@`` are searched.
    """
    text = F.col(f"`{text_col}`")
    matches, gaps, new = "__matches", "__gaps", "__new"
    found = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    out = docs.withColumn(matches, F.coalesce(found, F.array().cast("array<string>")))
    out = out.withColumn(gaps, F.when(F.size(matches) > 0, F.split(text, ANY, -1)))
    out = out.withColumn(new, F.transform(matches, lambda m: pseudonym(m, key)))
    joined = F.concat(F.array_join(F.zip_with(F.slice(gaps, 1, F.size(new)), new, lambda g, n: F.concat(g, n["text"])), ""),
                      F.element_at(gaps, -1))
    changed = F.aggregate(F.col(new), F.lit(0), lambda total, n: total + n["n"])
    return out.withColumn(text_col, F.when(F.size(matches) > 0, joined).otherwise(text)) \
        .withColumn("n_pseudonyms", changed.cast("long")).drop(matches, gaps, new)
