"""Personal data: detected entities receive keyed surrogates of the same type, format, script and gender.

One regular expression, with an alternative for each type, finds e-mail addresses, IPv4 and IPv6 addresses, payment cards and
account numbers (IBAN), both with valid check digits, national numbers of the form 3-2-4, telephone numbers, named secrets and passwords, access keys of a
known form, bearer tokens, and titled names. The name words of a titled person take the same stand-ins wherever else they stand alone in that text. An entity's canonical form decides its surrogate: addresses without case, digits without layout, name words one by one. So one
person or number reads the same everywhere, and the original layout and case are laid over the surrogate. Telephone numbers keep their country code and toll-free
codes, addresses of private networks their network; numbers of versions are none. count_into counts entities, not later mentions of a name.

The expression runs over each text once: rows are written with their entities. The distinct canonical forms of the corpus are gathered from that table, and it is
checked that no two share a surrogate and that no surrogate is itself someone's real value; the losers of a collision move to their next attempt, in a space that
grows, until none is left; numbers that attempts leave over are ranked into unused values. Then the written texts that hold entities
are split once more and rewritten. Attempt 0 is a pure function of key and value, so only entities that had to move are joined.

The key makes surrogates unpredictable: it comes from the caller or from quirework.pii.key in the session's configuration, and there is no default.

Everything is made of DataFrame functions. Defined results: null and empty texts stay as they are; repeated rows, and equal values anywhere (ties), are
rewritten alike; an empty table gives no rows; texts without entities are returned unchanged; numbers of a card's or account's form without valid check
digits are none. Patterns repeat no group without bound, so very long texts need no deep stack. Columns other than the text pass through,
whatever they are called; a column of the name count_into is replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

_MALE, _FEMALE, _OPEN = "Mr|Herr|Monsieur|Señor|Sr|Signor|MR|[гГ]-н|[κΚ]\\.", "Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Srta|Sra|Signora|MRS|[гГ]-жа|[κΚ]α", "Dr|Prof"
_TITLE = f"(?:{_MALE}|{_FEMALE}|{_OPEN})"
_NAME = r"\p{Lu}[\p{L}'’-]+"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_NAMED = r"token|secret|api[_-]?key|access[_-]?key|passwd|password|pwd"
_HEX = r"[0-9A-Fa-f]{1,4}"
#: Alternatives in order of precedence at one place. What is cheap and fails at most places comes first in each.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "key": r"(?=[Asprgxe])(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}|[spr]k[-_](?:live_|test_|proj-)?[A-Za-z0-9]{16,}(?![A-Za-z0-9])|gh[opsru]_[A-Za-z0-9]{36}(?![A-Za-z0-9])|xox[abprs]-[A-Za-z0-9-]{10,})",
    "secret": rf"(?<=[:= \"'])(?:(?=[+/_-]*[A-Za-z0-9])(?=[A-Za-z0-9+/_-]{{16}})(?<=(?i:{_NAMED})[\"']?[ ]{{0,2}}[:=][ ]{{0,2}}[\"']?)[A-Za-z0-9+/_-]{{16,}}"
    rf"|(?=[^\s\"',;]*\d)(?=[^\s\"',;]*\p{{L}})(?<=(?i:passwd|password|pwd)[\"']?[ ]{{0,2}}[:=][ ]{{0,2}}[\"']?)[^\s\"',;]{{6,}})",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ip6": rf"(?=[0-9A-Fa-f:]{{0,4}}:)(?<![\p{{L}}\d:.])(?=[A-Fa-f:]*\d)(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}(?::{_HEX}){{0,6}})?::(?:{_HEX}(?::{_HEX}){{0,6}})?)(?![\p{{L}}\d:])",
    "ip": rf"(?=\d)(?<![\d.])(?<!(?i:version|release|build|ver|\bv)[ .:]{{0,2}})(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "ssn": r"(?=\d)(?:(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])|(?<=(?i:ssn|social security number)[:# ]{1,3})\d{3} \d{2} \d{4}(?!\d))",
    "card": r"(?<!\d)(?:(?!00)\d{13,19}|\d{4}(?<gap>[ -])\d{4}\k<gap>\d{4}\k<gap>\d{4}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)",
    "phone": r"(?=[+(\d])(?<![\p{L}\d.+-])(?:(?:\+\d{1,3}[ .-]?|1[ .-])?(?:\(\d{2,4}\)[ .-]?\d{3}[ .-]?\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})|(?=\+(?:[ .-]?\d){7,15}(?![ .-]?\d))\+\d{1,3}(?:[ .-]\d{1,8}){2,6}|\+\d{1,3}(?:[ .-]\d{2,4}){2,4}|\+\d{9,14}|00[1-9]\d{8,12}(?!\d)|(?=00[1-9](?:[ .-]?\d){8,12}(?![ .-]?\d))00\d{1,3}(?:[ .-]\d{1,8}){2,6}|(?=0(?:[ .-]?\d){8,11}(?![ .-]?\d))(?!\d\d[ .-]\d\d[ .-]\d{4}(?!\d))0\d{1,4}(?:(?<by>[ .-])\d{2,4}(?:\k<by>\d{2,4}){1,4}|[ -]\d{6,8})|(?=\d{3}[ .-]\d{4})(?<=(?i:tel|phone|fax|mobile|call)[.:]? {1,2})\d{3}[ .-]\d{4})(?![\p{L}\d-])",
    "person": rf"(?=[MHDPSFгГκΚ])(?<!\p{{L}}){_TITLE}\.? {_NAME}(?: {_NAME})?",
}
#: What keys of a known form begin with and keep.
_KEY_HEAD = "A[KS]IA|eyJ|[spr]k[-_](?:live_|test_|proj-)?|gh[opsru]_|xox[abprs]-"
#: What numbers keep besides their length. Telephones: a country code, a leading 1 or 0, toll-free codes. Addresses: the octets of a private network.
#: Country codes of one and two digits (others have three), toll-free codes, private networks.
_CODES = "[17]|2[07]|3[0123469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
_TOLL_FREE = "8(?:00|33|44|55|66|77|88)"
_PHONE_HEAD = rf"^(?:\+(?:{_CODES}|\d{{3}})|1?{_TOLL_FREE}(?=\d{{7}}$)|1(?=\d{{10}}$)|0)"
_PRIVATE = r"^(?:10|127|192\.168|172(?=\.(?:1[6-9]|2\d|3[01])\.))\."
_PUBLIC = [n for n in range(1, 224) if n not in (10, 127, 172, 192)]
#: Group 1 is a secret, whose form may be that of another type.
ANY = "|".join(f"({p})" if kind == "secret" else f"(?:{p})" for kind, p in PATTERNS.items())
_GATE_TITLE = rf"(?=[MHDPSFгГκΚ])(?<!\p{{L}}){_TITLE}\.? \p{{Lu}}"


def may_hold(text: Column) -> Column:
    """False only for texts without any entity."""
    return text.rlike("[0-9@]") | text.contains("=") | text.contains("AKIA") | text.contains("ASIA") | text.rlike(_GATE_TITLE)


_SYLLABLES = {
    "latin": [c + v for c in "bdfgklmnprstv" for v in "aeiou"],
    "cyrillic": [c + v for c in "бвгдзклмнпрст" for v in "аеиоу"],
    "greek": [c + v for c in "βγδζκλμνπρστφ" for v in "αειου"],
}
_ENDINGS = {"latin": {"male": ["n", "rt", "s"], "female": ["a", "lia", "na"], "any": ["y", "l", "m"], "surname": ["ner", "ford", "ski"]}}
_ENDINGS["cyrillic"] = {"male": ["н", "р", "л"], "female": ["а", "ия", "на"], "any": ["м", "с", "т"], "surname": ["ко", "ер", "ин"]}
_ENDINGS["greek"] = {"male": ["ος", "ης", "ας"], "female": ["α", "η", "ια"], "any": ["ις", "ων", "ιν"], "surname": ["ιδης", "ου", "ακος"]}


def kind_of(m: Column) -> Column:
    """The type of a match of ANY, or null where it is no entity after all."""
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(rf"^(?:{_KEY_HEAD})"), "key")
        .when(m.rlike("^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$"), "ip6")
        .when(m.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9 ]{10,}$"), F.when(_mod97(F.concat(F.substr(_bare(m), F.lit(5)), F.substr(m, F.lit(1), F.lit(4)))) == 1, "iban"))
        .when(m.rlike(rf"^{_TITLE}\.? \p{{Lu}}"), "person")
        .when(m.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), "ip")
        .when(m.rlike(r"^\d{3}([ -])\d{2}\1\d{4}$"), "ssn")
        .when(m.rlike(r"^(?!00)(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}[ -]\d{6}[ -]\d{5})$"), F.when(F.call_function("luhn_check", _digits(m)), "card"))
        .when(m.rlike(r"^[+(\d][\d ().+-]*\d$") & m.rlike(r"[ ().+-]|^00"), "phone")
        .otherwise("secret")
    )


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def _bare(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit(""))


def _mod97(c: Column) -> Column:
    """The remainder by 97 of digits and capitals, the latter as numbers from 10."""
    def step(acc: Column, ch: Column) -> Column:
        return F.when(ch.rlike("[0-9]"), (acc * 10 + F.ascii(ch) - 48) % 97).otherwise((acc * 100 + F.ascii(ch) - 55) % 97)

    return F.aggregate(F.split(c, ""), F.lit(0), step)


def _name_parts(m: Column) -> Column:
    """(type, canonical form) of each name word of a titled name."""
    words = F.split(m, " ")
    title = F.regexp_replace(words[0], r"(?<=\p{L})\.$", "")
    gender = F.when(title.rlike(f"^(?:{_FEMALE})$"), "female").when(title.rlike(f"^(?:{_MALE})$"), "male").otherwise("any")
    given = F.when(F.size(words) > 2, F.array(F.struct(F.concat(F.lit("given-"), gender).alias("kind"), F.lower(words[1]).alias("canon"))))
    last = F.array(F.struct(F.lit("surname").alias("kind"), F.lower(F.element_at(words, -1)).alias("canon")))
    return F.coalesce(F.concat(given, last), last)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value worked out once."""
    return F.transform(F.array(value), body)[0]


def canonical(m: Column, kind: Column) -> Column:
    """The entities of a match of a kind as (kind, canon); empty where it is none."""
    # A number with a country code is one number whether it is written with + or 00; +1 is written or left out.
    abroad = F.when(m.rlike(r"^(?:\+(?!1)|00[2-9])"), F.concat(F.lit("+"), F.regexp_replace(_digits(m), "^00", ""))).otherwise(F.regexp_replace(_digits(m), "^001(?=[0-9]{10}$)", "1"))
    plain = F.when(kind.isin("email", "ip6"), F.lower(m)).when(kind == "phone", abroad).when(kind.isin("card", "ssn"), _digits(m)).when(kind == "iban", _bare(m)).otherwise(m)
    none = F.array().cast("array<struct<kind:string,canon:string>>")
    return F.when(kind.isNull(), none).when(kind == "person", _name_parts(m)).otherwise(F.array(F.struct(kind.alias("kind"), plain.alias("canon"))))


def entities(text: Column) -> Column:
    """All matches of a text in order as (m, kind, parts); null where there can be none."""
    matches = F.when(may_hold(text), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))

    def typed(ms: Column) -> Column:
        # A secret may have the form of another type: where one is named, each match tells whether its rule found it.
        secrets = F.when((F.size(ms) > 0) & text.rlike(f"(?i){_NAMED}"), F.regexp_extract_all(text, F.lit(ANY), F.lit(1)))
        return _let(secrets, lambda own: F.transform(ms, lambda m, i: F.struct(m.alias("m"), F.when(F.get(own, i) != "", "secret").otherwise(kind_of(m)).alias("kind"))))

    kinds = _let(matches, typed)
    return F.transform(kinds, lambda e: F.struct(e["m"].alias("m"), e["kind"].alias("kind"), canonical(e["m"], e["kind"]).alias("parts")))


def _number(h: Column, i: Column | int, below: int) -> Column:
    """A number below `below` from two bytes of a hexadecimal hash."""
    at = F.lit(i) if isinstance(i, int) else i
    return F.conv(F.substr(h, (at % 31) * 4 + 1, F.lit(4)), 16, 10).cast("int") % below


def _shaped(value: Column, h: Column, letters: int = 26) -> Column:
    """value with each digit and ASCII letter replaced by another of its kind; other letters become lower-case Latin."""
    def one(hs: Column, ch: Column, i: Column) -> Column:
        h = F.get(hs, F.floor(i / 31).cast("int"))
        letter = F.char(F.lit(97) + _number(h, i, letters))
        return F.when(ch.rlike("[0-9]"), _number(h, i, 10).cast("string")).when(ch.rlike("[A-Z]"), F.upper(letter)).when(ch.rlike(r"\p{L}"), letter).otherwise(ch)

    # A hash serves 31 places; each further stretch has its own.
    hashes = F.transform(F.sequence(F.lit(0), F.floor(F.length(value) / 31).cast("int")), lambda b: F.when(b == 0, h).otherwise(F.sha2(F.concat(h, b.cast("string")), 512)))
    return _let(hashes, lambda hs: F.array_join(F.transform(F.split(value, ""), lambda ch, i: one(hs, ch, i)), ""))


def _more(n: Column, h: Column, letters: int = 26) -> Column:
    """n letters (none below 1), from the end of a hash."""
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.char(F.lit(97) + _number(h, 31 - i % 31, letters))), "")).otherwise("")


def _email(canon: Column, h: Column, key: str, attempt: Column) -> Column:
    """One site stays one site, and its top-level domain stays; each further attempt makes the mailbox a letter longer."""
    site = F.substring_index(canon, "@", -1)
    top = F.substring_index(site, ".", -1)
    domain = _let(F.sha2(F.concat_ws("|", F.lit(key), F.lit("site"), site), 512), lambda hs: _shaped(F.substr(site, F.lit(1), F.length(site) - F.length(top) - 1), hs))
    return F.concat(_shaped(F.substring_index(canon, "@", 1), h), _more(attempt, h), F.lit("@"), domain, F.lit("."), top)


def _card(canon: Column, h: Column) -> Column:
    """As many digits, with a valid check digit."""
    body = F.concat(F.lit("4"), _shaped(F.substr(canon, F.lit(2), F.length(canon) - 2), h))
    return _let(body, lambda b: F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(b, d.cast("string"))), lambda x: F.call_function("luhn_check", x))[0])


def _account(canon: Column, h: Column) -> Column:
    """An account number of the same country and form, with valid check digits."""
    country = F.substr(canon, F.lit(1), F.lit(2))
    return _let(_shaped(F.substr(canon, F.lit(5)), h), lambda body: F.concat(country, F.lpad((98 - _mod97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0"), body))


def _name(kind: Column, canon: Column, h: Column, attempt: Column) -> Column:
    """A name word of the script of canon, with an ending for its gender or for a surname; a syllable longer with each further attempt."""
    def word(script: str) -> Column:
        parts = F.array(*map(F.lit, _SYLLABLES[script]))
        end = {k: F.array(*map(F.lit, v)) for k, v in _ENDINGS[script].items()}
        ending = reduce(lambda c, k: c.when(kind == f"given-{k}", end[k][_number(h, 3, 3)]), ("male", "female", "any"), F.when(kind == "surname", end["surname"][_number(h, 3, 3)]))
        more = F.when(attempt > 0, F.array_join(F.transform(F.sequence(F.lit(1), attempt), lambda i: F.get(parts, _number(h, i + 3, 65))), "")).otherwise("")
        return F.concat(*[parts[_number(h, i, 65)] for i in range(3)], more, ending)

    return F.when(canon.rlike(r"^\p{IsCyrillic}"), word("cyrillic")).when(canon.rlike(r"^\p{IsGreek}"), word("greek")).otherwise(word("latin"))


def _head(kind: Column, canon: Column) -> Column:
    """What the stand-in of a number begins with, as the number does."""
    return F.when(kind == "phone", F.regexp_extract(canon, _PHONE_HEAD, 0)).when(kind == "ip", F.regexp_extract(canon, _PRIVATE, 0)).otherwise("")


def _octets(head: Column, n: list[Column]) -> Column:
    """What follows a head of an address: of no network a public first octet, of 172 one of the private second ones, then octets from 1 to 254."""
    public, other = F.array(*map(F.lit, _PUBLIC)), [(x % 254 + 1).cast("string") for x in n]
    first = F.get(public, (n[0] % len(_PUBLIC)).cast("int")).cast("string")
    return (
        F.when(head == "", F.concat_ws(".", first, *other[1:])).when(head == "172.", F.concat_ws(".", (n[1] % 16 + 16).cast("string"), *other[2:]))
        .when(head == "192.168.", F.concat_ws(".", *other[2:])).otherwise(F.concat_ws(".", *other[1:]))
    )


def surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The canonical form that stands in for (kind, canon) at an attempt."""
    def of(h: Column) -> Column:
        ip = _let(_head(kind, canon), lambda head: F.concat(head, _octets(head, [_number(h, i, 1 << 16) for i in range(4)])))
        ip6 = F.concat_ws(":", F.lit("2001:db8"), *[F.lower(F.substr(h, F.lit(1 + 4 * k), F.lit(4))) for k in range(6)])  # addresses for documentation
        number = _let(_head(kind, canon), lambda head: F.concat(head, _shaped(F.substr(canon, F.length(head) + 1), h)))
        longer = attempt - 3
        secret = F.when(canon.rlike("^[0-9a-fA-F]+$"), F.concat(_shaped(canon, h, 6), _more(longer, h, 6))).otherwise(F.concat(_shaped(canon, h), _more(longer, h)))
        return (
            F.when(kind == "email", _email(canon, h, key, attempt)).when(kind == "card", _card(canon, h)).when(kind == "ip", ip)
            .when(kind.isin("phone", "ssn"), number).when(kind == "secret", secret).when(kind == "iban", _account(canon, h)).when(kind == "ip6", ip6)
            .when(kind == "key", _let(F.regexp_extract(canon, f"^(?:{_KEY_HEAD})", 0), lambda head: F.concat(head, _shaped(F.substr(canon, F.length(head) + 1), h)))).otherwise(_name(kind, canon, h, attempt))
        )

    return _let(F.sha2(F.concat_ws("|", F.lit(key), kind, attempt.cast("string"), canon), 512), of)


def _laid(original: Column, signs: Column, of: str = "[0-9]") -> Column:
    """signs in the layout of original, where they stand for what `of` matches."""
    at = lambda i: F.length(F.regexp_replace(F.substr(original, F.lit(1), i + 1), f"(?!{of}).", ""))
    return F.array_join(F.transform(F.split(original, ""), lambda ch, i: F.when(ch.rlike(of), F.substr(signs, at(i), F.lit(1))).otherwise(ch)), "")


def _cased(original: Column, word: Column) -> Column:
    """word (an address) in the case of original, mailbox and site each from their first letter."""
    like = lambda o, w: F.array_join(F.transform(F.split(w, ""), lambda ch, i: F.when(F.substr(o, i + 1, F.lit(1)).rlike(r"\p{Lu}"), F.upper(ch)).otherwise(ch)), "")
    return F.concat_ws("@", *[like(F.substring_index(original, "@", k), F.substring_index(word, "@", k)) for k in (1, -1)])


def _dialled(m: Column, number: Column) -> Column:
    """The digits of a number in the way m writes it: behind 00, a + or neither."""
    return _let(_digits(number), lambda d: F.when(m.startswith("00") & (number.startswith("+") | d.startswith("1")), F.concat(F.lit("00"), d)).otherwise(d))


def _stand_in(part: Column, moves: Column | None, key: str) -> Column:
    """What stands in for an entity (kind, canon)."""
    first = surrogate(part["kind"], part["canon"], F.lit(0), key)
    return first if moves is None else F.coalesce(F.try_element_at(moves, F.concat_ws("|", part["kind"], part["canon"])), first)


def _persons(found: Column, moves: Column | None, key: str) -> Column:
    """(word, stand_in) of the name words of all titled names of a text, as they are written there."""
    def words(e: Column) -> Column:
        written_as = F.slice(F.split(e["m"], " "), F.lit(2), F.size(e["parts"]))
        return F.zip_with(written_as, e["parts"], lambda w, part: F.struct(w.alias("word"), F.initcap(_stand_in(part, moves, key)).alias("stand_in")))

    return F.flatten(F.transform(F.filter(found, lambda e: e["kind"] == "person"), words))


def _with_mentions(segment: Column, persons: Column) -> Column:
    """Text between entities, with the name words of the text's titled persons replaced where they stand alone, a possessive s aside."""
    def mention(token: Column) -> Column:
        own = F.regexp_replace(token, "['’]s$", "")
        return _let(F.filter(persons, lambda p: p["word"] == own), lambda hit: F.when(F.size(hit) > 0, F.concat(F.get(hit, F.lit(0))["stand_in"], F.regexp_extract(token, "['’]s$", 0))).otherwise(token))

    tokens = F.regexp_extract_all(segment, F.lit(r"[\p{L}\p{M}'’-]+|[^\p{L}\p{M}'’-]+"), F.lit(0))
    return F.when(F.exists(persons, lambda p: F.contains(segment, p["word"])), F.array_join(F.transform(tokens, mention), "")).otherwise(segment)


def _rendered(e: Column, moves: Column | None, key: str) -> Column:
    """What stands in the text for an element of entities()."""
    m, kind = e["m"], e["kind"]

    def laid(new: Column) -> Column:
        return (
            F.when(kind == "person", F.concat_ws(" ", F.substring_index(m, " ", 1), F.array_join(F.transform(new, lambda w: F.initcap(w)), " ")))
            .when(kind == "email", _cased(m, new[0])).when(kind == "phone", _laid(m, _dialled(m, new[0]))).when(kind.isin("card", "ssn"), _laid(m, new[0])).when(kind == "iban", _laid(m, new[0], "[A-Z0-9]")).otherwise(new[0])
        )

    return F.when(kind.isNull(), m).otherwise(_let(F.transform(e["parts"], lambda part: _stand_in(part, moves, key)), laid))


#: Kinds whose stand-ins keep their length.
_NUMBERS = ("card", "ip", "phone", "ssn")


def _form(kind: Column, canon: Column) -> Column:
    """What a stand-in of a number keeps besides its kind: its length and what it begins with."""
    return F.concat(F.when(kind == "ip", "").otherwise(F.length(canon).cast("string")), F.lit("|"), _head(kind, canon))


def _nth(kind: str, form: str, n: Column) -> tuple[Column, int]:
    """The n-th value of a form, and how many there are."""
    length, head = form.split("|")
    if kind == "ip":
        sizes = {"": [len(_PUBLIC), 254, 254, 254], "172.": [1, 16, 254, 254], "192.168.": [1, 1, 254, 254]}.get(head, [1, 254, 254, 254])
        digits, rest = [], n
        for size in reversed(sizes):
            digits.insert(0, rest % size)
            rest = F.floor(rest / size)
        return F.concat(F.lit(head), _octets(F.lit(head), digits)), sizes[0] * sizes[1] * sizes[2] * sizes[3]
    tail = 0
    if kind == "card":
        head, tail = "4", 1
    free = int(length) - len(head) - tail
    body = F.concat(F.lit(head), F.lpad(n.cast("string"), free, "0"))
    if kind == "card":
        body = _let(body, lambda b: F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(b, d.cast("string"))), lambda x: F.call_function("luhn_check", x))[0])
    return body, 10**free


def _ranked(df: DataFrame, order: str) -> DataFrame:
    """df with its rank from 0, counted in parts."""
    part = written(df.repartitionByRange(order).sortWithinPartitions(order).select("*", F.spark_partition_id().alias("part"), (F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).alias("i")), "parts")
    counts = sorted(map(tuple, part.groupBy("part").count().collect()))
    before = {p: sum(n for q, n in counts if q < p) for p, _ in counts}
    starts = F.create_map(*[F.lit(x) for p in before.items() for x in p]) if before else F.create_map().cast("map<int,long>")
    return part.select(*df.columns, (starts[F.col("part")] + F.col("i")).alias("rank"))


def _rest(state: DataFrame, losers: DataFrame) -> DataFrame:
    """losers (kind, canon) of numbers with stand-ins that nobody has: the n-th of a form takes the n-th unused value.
    state: kind, canon and stand_in of all entities. Of as many values as are lost or in use, enough are unused."""
    losers = written(losers.withColumn("form", _form(F.col("kind"), F.col("canon"))), "losers")
    kept = state.join(losers.select("kind", "canon"), ["kind", "canon"], "left_anti").select("kind", F.col("stand_in").alias("used"))
    used = written(kept.unionByName(state.select("kind", F.col("canon").alias("used"))).distinct(), "used")
    out = []
    for g in losers.groupBy("kind", "form").count().collect():
        mine = losers.where((F.col("kind") == g["kind"]) & (F.col("form") == g["form"]))
        taken = used.where((F.col("kind") == g["kind"]) & (_form(F.col("kind"), F.col("used")) == g["form"]))
        value, most = _nth(g["kind"], g["form"], F.col("id"))
        free = losers.sparkSession.range(min(most, g["count"] + taken.count())).select(value.alias("stand_in"))
        free = written(free.join(taken.select(F.col("used").alias("stand_in")), "stand_in", "left_anti"), "free")
        if free.count() < g["count"]:
            raise ValueError(f"more than half of all numbers of form {g['kind']} {g['form']} are in the texts: no others are left to stand in for them")
        out.append(_ranked(mine.select("kind", "canon"), "canon").join(_ranked(free, "stand_in"), "rank").select("kind", "canon", "stand_in"))
    return written(reduce(DataFrame.unionByName, out), "rest")


def detected(docs: DataFrame) -> DataFrame:
    """row (all columns of docs) and found (its entities), written: what follows reads it, and no text is searched twice."""
    return written(docs.select(F.struct(*docs.columns).alias("row"), entities(F.col("text")).alias("found")), "detected")


def moved(rows: DataFrame, key: str, most_rounds: int = 20) -> DataFrame | None:
    """(kind, canon, stand_in) of the entities of rows (from detected()) whose first surrogate collided, or None if none did. Names, addresses and secrets
    get longer with their attempts until none collides; numbers, whose length is fixed, that still do after most_rounds take unused values."""
    found = rows.select(F.explode(F.array_distinct(F.flatten(F.transform("found", lambda e: e["parts"])))).alias("e")).select("e.*").distinct()
    state = written(found.withColumn("attempt", F.lit(0)), "entities")
    real = state.select(F.col("kind").alias("k"), F.col("canon").alias("c"))
    turn = 0
    while True:
        now = state.withColumn("stand_in", surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key))
        first = now.groupBy("kind", "stand_in").agg(F.count("*").alias("n"), F.min_by("canon", F.struct("attempt", F.xxhash64("canon"), "canon")).alias("owner"))
        known = first.join(real, (F.col("kind") == F.col("k")) & (F.col("stand_in") == F.col("c")), "left")
        clash = written(known.where("n > 1 OR c IS NOT NULL").select("kind", "stand_in", F.when(F.col("c").isNull(), F.col("owner")).alias("owner")), "clashes")
        moves = now.where("attempt > 0").select("kind", "canon", "stand_in")
        if clash.isEmpty():
            return moves if turn else None
        loses = F.coalesce(F.col("clashing") & ~F.col("canon").eqNullSafe(F.col("owner")), F.lit(False))
        now = now.join(clash.withColumn("clashing", F.lit(True)), ["kind", "stand_in"], "left").select("kind", "canon", "attempt", "stand_in", loses.alias("loses"))
        if turn >= most_rounds and clash.where(~F.col("kind").isin(*_NUMBERS)).isEmpty():
            now = written(now, "entities")
            rest = _rest(now, now.where("loses").select("kind", "canon"))
            return now.where("attempt > 0 AND NOT loses").select("kind", "canon", "stand_in").unionByName(rest)
        turn += 1
        state = written(now.select("kind", "canon", (F.col("attempt") + F.col("loses").cast("int")).alias("attempt")), "entities")


#: Known to everyone: only for the registered queries and the pipeline where the session names no key, never for real data.
PUBLIC_KEY = "surrogates"


def key_of(spark: SparkSession, otherwise: str | None = None) -> str:
    """The secret key of surrogates, from quirework.pii.key of the session's configuration."""
    key = spark.conf.get("quirework.pii.key", None) or otherwise
    if not key:
        raise ValueError("surrogates need a secret key: pass one, or set quirework.pii.key")
    return key


def replace_entities(docs: DataFrame, key: str | None = None, count_into: str | None = None) -> DataFrame:
    """docs with surrogates in text; count_into names a column for the number of entities replaced."""
    key = key or key_of(docs.sparkSession)
    rows = detected(docs)
    exceptions = moved(rows, key)
    text, found, moves = F.col("row.text"), F.col("found"), None
    if exceptions is not None:
        # Rows that share an id, or have none, are told apart by their text, so what meets in one row is bounded by a text.
        rows = rows.withColumn("_text", F.xxhash64("row.text"))
        hit = rows.select(F.col("row.doc_id").alias("_doc"), F.col("_text").alias("_of"), F.explode(F.flatten(F.transform(found, lambda e: e["parts"]))).alias("e")).select("_doc", "_of", "e.*").distinct()
        by_doc = hit.join(exceptions, ["kind", "canon"]).groupBy("_doc", "_of").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "canon"), "stand_in"))).alias("moves"))
        rows = rows.join(by_doc, F.col("row.doc_id").eqNullSafe(F.col("_doc")) & (F.col("_text") == F.col("_of")), "left")
        moves = F.col("moves")
    stand_ins = F.concat(F.transform(found, lambda e: _rendered(e, moves, key)), F.array(F.lit("")))
    joined = lambda segments: F.array_join(F.zip_with(segments, stand_ins, lambda s, m: F.concat(s, m)), "")
    segments = F.split(text, ANY, -1)
    named = _let(_persons(found, moves, key), lambda persons: joined(F.transform(segments, lambda s: _with_mentions(s, persons))))
    new = F.when(F.exists(found, lambda e: e["kind"] == "person"), named).when(F.size(found) > 0, joined(segments)).otherwise(text)
    columns = [new.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c != count_into]
    count = F.coalesce(F.size(F.filter(found, lambda e: e["kind"].isNotNull())), F.lit(0))
    return rows.select(*columns, *([count.alias(count_into)] if count_into else []))
