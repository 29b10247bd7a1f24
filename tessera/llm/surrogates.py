"""Personal data: detection and keyed surrogates of the same type and form.

**Detected** are e-mail addresses, phone numbers (with +, parentheses or parted 3-3-4), payment cards (right check digit), IPv4 addresses, national numbers of the form 3-2-4,
IBANs, cloud access keys, values after words such as ``password=``, ``API_KEY =`` and ``"db_token": ``, and names after a form of address, in
Latin and Cyrillic script; names in other scripts aren't looked for. Time grows in proportion to a text's length.

**Surrogates.** A number or key is mapped by a keyed permutation of all strings of its form (a Feistel network over mixed radices): digits
stay digits, letters stay letters of their case, marks, country codes and issuers stay, check digits are made right. A name
part becomes a keyed name of the same gender, script and case; where the corpus uses one name in several roles, the role of most rows
decides for all. Equal values get equal surrogates in all documents, names whatever their case.

**Collisions.** All distinct values of the corpus are listed. A surrogate that two values share, or that is itself a value of the
corpus, is made anew with the next attempt number, until there is none. Permutations rarely need that; names may.

**Key.** Whoever has the key can undo the permutations. Without a key one is drawn at random for the run and kept nowhere.

Only documents with a detected value are joined with the list; all others pass by without a shuffle.
"""

from __future__ import annotations

import hashlib
import re
import secrets
from bisect import bisect_left
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, slices, texts_of, unused

LOWER, UPPER, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"

#: Forms of address and the gender they tell; fixed values.
ADDRESS = {
    "Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Don": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mademoiselle": "f", "Señora": "f", "Sra": "f", "Doña": "f",
    "Dr": "", "Prof": "", "господин": "m", "Господин": "m", "госпожа": "f", "Госпожа": "f",
}
#: Syllables of surrogate names by script; fixed values.
SYLLABLES = {
    "latin": ("bal den far gor hel jor kal lor mar nor pel ros sal tor vel wen".split(), "a e i o u an en in".split(), {"m": "do ro ko mon rik".split(), "f": "la na ria line tta".split(), "": "berg ford holm stein well".split()}),
    "cyrillic": ("бал вер гор дар жан зор кал лор мар нор пел рос сал тор".split(), "а е и о у ан ен ин".split(), {"m": "дор мир рик слав тон".split(), "f": "ла на рия лина тта".split(), "": "берг дорф ский штейн вель".split()}),
}

#: A part of a name has 2 to 64 characters.
_NAME = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][\w’'-]{0,62}\w(?![\w])"
_ADDRESSED = re.compile(rf"\b(?P<title>{'|'.join(sorted(ADDRESS, key=len, reverse=True))})\b\.?[ ](?P<name>{_NAME}(?: {_NAME}){{0,2}})")
_WORD = re.compile(r"\w+")
_TITLES = tuple(t + s for t in ADDRESS for s in (" ", ". "))
#: Words that announce a secret, in any case, also within an identifier.
_WORDS = "password|passwd|passphrase|pwd|secret|token|api[ _-]?key|access[ _-]?key|auth"
#: In the order in which they claim a place; each but the secret has a bounded length, so a search takes time in proportion to the text.
_FORMS = re.compile(
    r"""(?:(?=[PpSsTtAa])(?i:@WORDS@)(?:[_-][A-Za-z0-9_-]{0,64}|[A-Z][a-z][A-Za-z0-9]{0,64}|[0-9]{1,8})?(?:\\?["'])?\s*[=:]\s*(?:\\?["'])?)(?P<secret>[A-Za-z0-9+/_\-]{8,})
    |\b(?P<accesskey>(?:AKIA|ASIA)[A-Z0-9]{16})\b
    |\b(?P<iban>[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?)\b
    |(?P<phone>(?<![\w+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}(?![\w])|(?<![\w+])\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![\w])
        |(?<![\w+])(?<![02-9][.-])(?<![0-9]1[.-])[0-9]{3}(?:-[0-9]{3}-|\.[0-9]{3}\.|[ ][0-9]{3}[ -])[0-9]{4}(?![\w]|[.-][0-9]))
    |(?<![\w.-])(?P<national>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![\w-])
    |(?<![\w.])(?P<card>[0-9](?:[ -]?[0-9]){12,18})(?![\w])
    |(?<![\w.])(?P<ip>(?:[0-9]{1,3}\.){3}[0-9]{1,3})(?![\w]|\.[0-9])
    |\b(?P<hexkey>[0-9a-f]{32}(?:[0-9a-f]{8})?(?:[0-9a-f]{24})?)\b""".replace("@WORDS@", _WORDS),
    re.X,
)
_MAY = re.compile(f"[0-9]|{_WORDS}", re.I)


def luhn(digits: str) -> int:
    """The sum modulo 10; 0 where the last digit is a right check digit."""
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _valid(kind: str, value: str) -> bool:
    if kind == "card":
        d = re.sub(r"\D", "", value)
        return luhn(d) == 0 and len(set(d)) > 1
    if kind == "ip":
        return all(int(p) < 256 and (p == "0" or p[0] != "0") for p in value.split("."))
    if kind == "iban":
        return 15 <= len(value.replace(" ", "")) <= 34 and _iban_rest(value.replace(" ", "")) == 1
    if kind == "hexkey":
        return bool(re.search("[0-9]", value) and re.search("[a-f]", value))
    return True


def _script(word: str) -> str:
    return "cyrillic" if re.match("[А-яЁё]", word) else "latin"


_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+")
_TOP = re.compile("[A-Za-z]{2,}")


def addresses(text: str) -> list[tuple[int, int]]:
    """(begin, end) of each e-mail address: what stands about each @."""
    found, last = [], 0
    at = text.find("@")
    while at >= 0:
        a = at
        while a > last and text[a - 1] in _LOCAL:
            a -= 1
        while a < at and text[a] in "._%+-":
            a += 1
        z = 0
        if a < at and (m := _DOMAIN.match(text, at + 1)):
            labels = m[0].split(".")
            end = m.end()
            for i in range(len(labels) - 1, 0, -1):
                if top := _TOP.match(labels[i]):
                    z = end - len(labels[i]) + top.end()
                    break
                end -= len(labels[i]) + 1
        if z:
            found.append((a, z))
            last = z
        at = text.find("@", max(at + 1, z))
    return found


class Places:
    """Spans apart from each other, in order."""

    def __init__(self, spans: list[tuple[int, int, str]]):
        self.spans = spans
        self.begins = [s[0] for s in spans]

    def free(self, a: int, z: int) -> bool:
        i = bisect_left(self.begins, z)
        return not i or self.spans[i - 1][1] <= a


def names(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Names after a form of address, and the same names, also in capitals, elsewhere in the text, where ``taken`` leaves room."""
    places, found, known = Places(taken), [], {}
    for m in _ADDRESSED.finditer(text):
        words, gender, at = m["name"].split(" "), ADDRESS[m["title"]], m.start("name")
        for i, w in enumerate(words):
            known[w] = kind = f"{'surname' if i == len(words) - 1 else 'given' + gender}.{_script(w)}"
            if places.free(at, at + len(w)):
                found.append((at, at + len(w), kind))
            at += len(w) + 1
    if not known:
        return found
    known |= {w.upper(): kind for w, kind in known.items()}
    places = Places(sorted(taken + found))
    lengths: dict[str, list[int]] = {}  # of the known names by their first word
    for w in known:
        lengths.setdefault(_WORD.match(w)[0], []).append(len(w))
    lengths = {w: sorted(set(n), reverse=True) for w, n in lengths.items()}
    last = 0
    for m in _WORD.finditer(text):
        a = m.start()
        for n in lengths.get(m[0], ()):
            w = text[a : a + n]
            if a >= last and w in known and not (text[a + n : a + n + 1] and _WORD.match(text, a + n)):
                if places.free(a, a + n):
                    found.append((a, a + n, known[w]))
                    last = a + n
                break
    return found


def detect(text: str) -> list[tuple[int, int, str]]:
    """(begin, end, kind) of each value, in order and apart from each other: addresses first, then other forms from left to right, then names."""
    found = [(a, z, "email") for a, z in addresses(text)]
    if _MAY.search(text):
        places, at = Places(found), 0
        found = found.copy()
        while m := _FORMS.search(text, at):
            kind = m.lastgroup
            a, z = m.span(kind)
            if _valid(kind, m[kind]) and places.free(a, z):
                found.append((a, z, kind))
                at = max(z, at + 1)
            else:
                at = m.start() + 1
        found.sort()
    if any(t in text for t in _TITLES):
        found += names(text, found)
    return sorted(found)


# ---------------------------------------------------------------- surrogates
def _number(key: bytes, tweak: str, bits: int) -> int:
    size = (bits + 7) // 8
    out = hashlib.blake2b(tweak.encode(), key=key, digest_size=min(64, max(8, size + 8))).digest()
    while len(out) < size + 8:
        out += hashlib.blake2b(out, key=key).digest()
    return int.from_bytes(out, "big")


def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size): a balanced Feistel network over the next even number of bits, walked until it falls inside."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for r in range(10):
            left, right = right, left ^ (_number(key, f"{tweak}|{r}|{right}", half) & mask)
        value = left << half | right
        if value < size:
            return value


def recode(text: str, key: bytes, tweak: str, fixed: frozenset[int] = frozenset(), hexadecimal: bool = False) -> str:
    """Permute all strings of the form of ``text``: each digit, small letter and capital outside ``fixed`` keeps its class."""
    sets = [None if i in fixed else HEX if hexadecimal and c in HEX else next((s for s in (DIGITS, LOWER, UPPER) if c in s), None) for i, c in enumerate(text)]
    value, size, form = 0, 1, []
    for c, s in zip(text, sets, strict=True):
        form.append(c if s is None else str(len(s)) + s[0])
        if s:
            value, size = value * len(s) + s.index(c), size * len(s)
    value = permute(value, size, key, f"{tweak}|{''.join(form)}")
    out = list(text)
    for i in range(len(text) - 1, -1, -1):
        if sets[i]:
            value, r = divmod(value, len(sets[i]))
            out[i] = sets[i][r]
    return "".join(out)


def surrogate(kind: str, value: str, key: bytes, attempt: int = 0) -> str:
    tweak = f"{kind}|{attempt}"
    if kind == "email":
        local, domain = value.split("@")
        names, dot, top = domain.rpartition(".")
        return recode(local, key, f"{tweak}|{domain}") + "@" + recode(names, key, f"{tweak}|{top}") + dot + top
    if kind == "phone":
        country = re.match(r"\+[0-9]{1,3}(?=[ .(-])", value)
        return recode(value, key, tweak, frozenset(range(country.end() if country else 0)))
    if kind == "card":
        at = [i for i, c in enumerate(value) if c.isdigit()]
        out = recode(value, key, tweak + value[at[0]] + str(len(at)), frozenset({at[0], at[-1]}))
        body = "".join(out[i] for i in at[:-1])
        return out[: at[-1]] + str((10 - luhn(body + "0")) % 10) + out[at[-1] + 1 :]
    if kind == "ip":
        n = 0
        for p in value.split("."):
            n = n * 256 + int(p)
        n = permute(n, 1 << 32, key, tweak)
        return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
    if kind == "iban":
        bare = [i for i, c in enumerate(value) if c != " "]
        out = list(recode(value, key, tweak + value[:2], frozenset(bare[:4])))
        text = "".join(out[i] for i in bare)
        out[bare[2]], out[bare[3]] = f"{98 - _iban_rest(text[:2] + '00' + text[4:]):02d}"
        return "".join(out)
    if kind == "accesskey":
        return recode(value, key, tweak, frozenset(range(4)))
    if kind in ("secret", "hexkey"):
        return recode(value, key, tweak, hexadecimal=bool(re.fullmatch("[0-9a-f]+", value)))
    if kind == "national":
        return recode(value, key, tweak)
    part, script = kind.split(".")
    first, middle, last = SYLLABLES[script]
    last = last[part[5:] if part.startswith("given") else ""]
    n = _number(key, f"{tweak}|{value.lower()}", 64 * (1 + attempt))
    name = ""
    for syllables in [first, middle] * (1 + attempt) + [last]:  # later attempts give longer names: the supply never ends
        n, r = divmod(n, len(syllables))
        name += syllables[r]
    return name.upper() if value.isupper() and len(value) > 1 else name.capitalize()


@lru_cache(maxsize=100_000)
def _surrogate(kind: str, value: str, key: bytes, attempt: int) -> str:
    return surrogate(kind, value, key, attempt)


def role(kind: str, value: str) -> tuple[str, str]:
    """What a value's surrogate is looked up by: names by their small letters, whatever their role."""
    return ("name", value.lower()) if "." in kind else (kind, value)


def cased(name: str, like: str) -> str:
    return name.upper() if like.isupper() and len(like) > 1 else name.capitalize()


def assign(values: DataFrame, key: bytes, most_rounds: int = 64) -> DataFrame:
    """``values`` (kind, value, role, n), distinct by (kind, value), with surrogates that differ from each other and from all values."""

    def make(batches):
        for b in batches:
            rows = zip(b.column("kind").to_pylist(), b.column("value").to_pylist(), b.column("role").to_pylist(), b.column("attempt").to_pylist(), strict=True)
            new = [_surrogate(r, v, key, a).lower() if k == "name" else _surrogate(r, v, key, a) for k, v, r, a in rows]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new, pa.string())], [*b.schema.names, "surrogate"])

    schema = "kind string, value string, role string, n long, attempt int, surrogate string"
    held = materialize(values.withColumn("attempt", F.lit(0)).mapInArrow(make, schema), "surrogates")
    originals = values.select(F.col("value").alias("surrogate")).distinct()
    for _ in range(most_rounds):
        # of several values with one surrogate, the first to have it keeps it
        kept = held.groupBy("surrogate").agg(F.min(F.struct("attempt", "kind", "value")).alias("owner"), F.count("*").alias("n"))
        bad = kept.where("n > 1").select("surrogate", "owner").union(held.join(originals, "surrogate", "left_semi").select("surrogate", F.lit(None).cast("struct<attempt:int,kind:string,value:string>").alias("owner")))
        bad = materialize(bad.groupBy("surrogate").agg(F.min_by("owner", F.col("owner").isNotNull()).alias("owner")), "collisions")
        if not bad.limit(1).count():
            return held.drop("attempt")
        marked = held.join(bad.withColumn("hit", F.lit(True)), "surrogate", "left")
        again = F.col("hit").isNotNull() & ~F.coalesce(F.struct("attempt", "kind", "value") == F.col("owner"), F.lit(False))
        held = materialize(marked.select("kind", "value", "role", "n", (F.col("attempt") + again.cast("int")).alias("attempt")).mapInArrow(make, schema), "surrogates")
    raise RuntimeError("surrogates still collide")


#: A value with more than this share of all uses is frequent; fewer than 1 / FREQUENT values are.
FREQUENT = 0.001


def replace_personal(docs: DataFrame, *, key: bytes | None = None, text: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, and n_replaced long (places), kinds string (their kinds, sorted, comma between).

    ``key`` (else the setting spark.tessera.surrogates.key) makes the surrogates; without one they differ from run to run. A null text stays
    null, an empty one empty. Rows without personal data stay as they are. Repeated rows get the same replacements; no doc_id is read, so
    rows that share one or have none are like any other. An empty table gives an empty result. All columns stay; columns named n_replaced or
    kinds, whatever their case, are replaced.
    """
    if key is None:
        named = docs.sparkSession.conf.get("spark.tessera.surrogates.key", None)
        key = named.encode() if named else secrets.token_bytes(32)
    key = hashlib.blake2b(key).digest()
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_replaced", "kinds")])
    names, schema = docs.columns, docs.schema
    at, row_, marks_, new_ = names.index(text), unused("row", names), unused("marks", names), unused("new", names)

    def clean(batches):
        for b in slices(batches, 1024, 4_000_000):
            keep = pa.array([not detect(t) for t in texts_of(b, text)], pa.bool_())
            b = b.filter(keep)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([0] * b.num_rows, pa.int64()), pa.array([""] * b.num_rows, pa.string())], [*names, "n_replaced", "kinds"])

    marks = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]))
    struct = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def hit(batches):
        for b in slices(batches, 1024, 4_000_000):
            found = [detect(t) for t in texts_of(b, text)]
            some = pa.array([bool(f) for f in found], pa.bool_())
            spans = pa.array([[{"begin": x, "end": y, "kind": k} for x, y, k in f] for f in found if f], struct)
            yield pa.RecordBatch.from_arrays([*b.filter(some).columns, spans], [*names, marks_])

    hits = docs.mapInArrow(hit, T.StructType([*schema.fields, T.StructField(marks_, marks)])).withColumn(row_, F.monotonically_increasing_id())
    hits = materialize(hits, "personal")

    def values(batches):
        for b in slices(batches, 1024, 4_000_000):
            out = ([], [], [], [])
            for r, t, f in zip(b.column(row_).to_pylist(), b.column(text).to_pylist(), b.column(marks_).to_pylist(), strict=True):
                for (kind, value), of in {role(m["kind"], t[m["begin"] : m["end"]]): m["kind"] for m in reversed(f)}.items():
                    for column, x in zip(out, (r, kind, value, of), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(x, pa.string()) for x in out[1:])], ["row", "kind", "value", "role"])

    uses = materialize(hits.select(row_, text, marks_).mapInArrow(values, "row long, kind string, value string, role string"), "uses")
    roles = uses.groupBy("kind", "value", "role").agg(F.count("*").alias("n")).groupBy("kind", "value").agg(F.max_by("role", F.struct("n", "role")).alias("role"), F.sum("n").alias("n"))
    new = assign(materialize(roles, "values"), key)
    frequent = F.broadcast(new.where(F.col("n") > FREQUENT * uses.count()).select("kind", "value", "surrogate"))  # fewer than 1 / FREQUENT rows
    uses = uses.drop("role")
    given = uses.join(frequent, ["kind", "value"]).union(uses.join(frequent, ["kind", "value"], "left_anti").join(new.select("kind", "value", "surrogate"), ["kind", "value"]))
    given = given.groupBy(F.col("row").alias(unused("used", [*names, row_]))).agg(F.collect_list(F.struct("kind", "value", "surrogate")).alias(new_))
    whole = hits.join(given, hits[row_] == given[given.columns[0]]).select(*(hits[c] for c in (*names, marks_)), new_)

    def put(batches):
        for b in slices(batches, 1024, 4_000_000):
            texts, n, kinds = [], [], []
            for t, f, g in zip(b.column(text).to_pylist(), b.column(marks_).to_pylist(), b.column(new_).to_pylist(), strict=True):
                to = {(x["kind"], x["value"]): x["surrogate"] for x in g}
                out, last = [], 0
                for m in f:
                    value = t[m["begin"] : m["end"]]
                    surrogate = to[role(m["kind"], value)]
                    out += [t[last : m["begin"]], cased(surrogate, value) if "." in m["kind"] else surrogate]
                    last = m["end"]
                texts.append("".join([*out, t[last:]]))
                n.append(len(f))
                kinds.append(",".join(sorted({m["kind"].split(".")[0] for m in f})))
            columns = [b.column(c) for c in names]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(kinds, pa.string())], [*names, "n_replaced", "kinds"])

    out = T.StructType([*schema.fields, T.StructField("n_replaced", T.LongType()), T.StructField("kinds", T.StringType())])
    return docs.mapInArrow(clean, out).union(whole.mapInArrow(put, out))
