"""Problem 6: defective prompt and response pairs get the type of their defect.

- empty: no reply, or nothing but blanks, marks or a placeholder.
- copy: the reply is compressed with zstandard, with the prompt as raw dictionary; what the prompt doesn't explain is
  the size of the result. A copy leaves next to nothing, a reply that repeats the question and then answers leaves the
  answer.
- refusal: after greetings are taken off, each sentence matches the refusal dictionary of a language.
- other_language: language dictionaries, grown from seeds, give another language than the prompt's, and the prompt names no
  language by which the reply's was asked for.
- truncated: a reply without final mark, or with an ellipsis, whose last words, by a terminal-context model, hardly ever
  end a sentence.

Dictionaries and contexts are counted over all rows. Of the contexts only those at the ends of replies are asked for, so
their hashes set the bits of a bounded table first (in tasks), then all replies are counted for the contexts in the table,
and the counts reach the replies that ask for them by a join. A context that shares a slot with another is counted too,
which changes nothing.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Inverse of the share of all (text, word) rows from which a word can be in a language dictionary: there are fewer words than that.
VOCABULARY = 200_000
#: Bits of the table of contexts asked for, per context, and at most (over that, more contexts than asked for are counted).
ASKED_BITS, MOST_BITS = 16, 27

# Seeds of the language dictionaries, names of languages, placeholders, greetings, quoting phrases and refusal wordings.
SEEDS = {
    "en": "the and of is to in on with for what how which where does can you please when that are from by your it this not",
    "ms": "yang dan di dengan untuk pada ialah tidak adakah bagaimana apakah mengapa saya boleh daripada ini itu dalam oleh kepada akan selepas",
    "fr": "le la les des et est du une dans pour que quel quelle comment pourquoi avec sur vous ne pas au par il votre",
    "de": "der die das und ist nicht mit ein eine für auf wie warum welche den dem sie kann wo auch zu von wird",
    "es": "el los las una es y del qué cómo por para con cuál dónde se puede en la que su más no está",
}
LANGUAGE_NAMES = {
    "en": "english inggeris anglais englisch englischer inglés ingles",
    "ms": "malay melayu malaysia malais malaiisch malayo malayisch",
    "fr": "french perancis français francais französisch franzoesisch francés frances",
    "de": "german jerman allemand deutsch alemán aleman",
    "es": "spanish sepanyol espagnol spanisch español espanol castellano",
}
PLACEHOLDERS = frozenset("null none nil nan n/a na undefined empty tbd todo no response no reply no answer tiada kosong leer vacío vacio vide keine aucune ninguna".split()) | {"no response", "no reply", "no answer"}
LEADS = (
    "you asked", "your question was", "your question", "the question was", "question", "soalan anda", "anda bertanya", "votre question", "vous avez demandé", "vous demandez", "ihre frage", "sie fragten",
    "sie haben gefragt", "su pregunta", "usted preguntó", "tu pregunta", "preguntó", "pertanyaan anda", "soalan",
)
GREETING = re.compile(
    r"^[¡¿\"'(\s]*(?:(?:hello|hi|hey|hai|salam|bonjour|salut|hallo|guten tag|hola|buenos días|thank you for (?:your message|asking)|thanks for (?:your message|asking)|terima kasih atas (?:mesej|soalan) anda|terima kasih"
    r"|merci (?:pour|de) (?:votre message|votre question)|vielen dank für ihre (?:nachricht|frage)|danke für ihre (?:nachricht|frage)|gracias por su (?:mensaje|pregunta))\b[ ,]*[.!,;:]+\s*)+",
    re.I,
)
REFUSAL = re.compile(
    "|".join((
        r"\b(?:can(?:no|')?t|cannot|unable to|not able to|won't be able to|am not allowed to|not permitted to) (?:help|assist|answer|provide|discuss|comment|respond|share|continue|talk)",
        r"\b(?:must|have to|need to) (?:decline|refuse)\b", r"\brather not (?:comment|answer|discuss|say)", r"\bno answer can be given", r"\b(?:guidelines|policy|policies|rules) (?:do|does) not (?:allow|permit)",
        r"\b(?:beyond|outside|out of) (?:my scope|what i can)", r"\bwon't be continuing", r"\bdon't have permission", r"\bdo not have permission",
        r"\btidak (?:dapat|boleh|mampu) (?:membantu|menjawab|memberikan|mengulas|membincangkan|berkongsi)", r"\btidak dibenarkan", r"\bgaris panduan saya tidak", r"\bterpaksa saya tolak", r"\bdi luar (?:skop|bidang) saya", r"\btiada jawapan (?:dapat|boleh)", r"\bsaya (?:perlu|terpaksa) menolak", r"\blebih suka tidak",
        r"\b(?:ne peux pas|ne suis pas (?:autoris\w+|en mesure)|consignes ne me permettent|dois (?:malheureusement )?(?:refuser|décliner)|m'est impossible|dépasse mon domaine|préfère ne pas|aucune réponse ne peut)",
        r"\b(?:kann ich (?:leider )?(?:nicht|keine)|darf ich (?:leider )?(?:nicht|keine)|muss ich diese anfrage|vorgaben lassen|außerhalb meines bereichs|möchte ich (?:mich )?(?:nicht|lieber nicht)|leider nicht (?:beantworten|helfen)|keine antwort (?:geben|möglich))",
        r"\b(?:no (?:puedo|estoy autorizad[oa]|me es posible)|directrices no me permiten|debo rechazar|fuera de mi (?:ámbito|alcance)|prefiero no|no se puede dar respuesta)",
    )),
    re.I,
)

LANGS = tuple(SEEDS)
_NAMES = {n: lang for lang, names in LANGUAGE_NAMES.items() for n in names.split()}
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_TOKEN = re.compile(r"[^\W_]+(?:[-_./'’·][^\W_]+)*|[.!?…。！？]+|[,;:()]")
_END = re.compile(r"[.!?…。！？]['\"»”’)\]*_`]*$")
_SPACE, _LETTERS = re.compile(r"[\W_]+"), re.compile(r"[^\W\d_]{3}")
_MARK = re.compile(r"^[.!?…。！？]")
_ELLIPSIS = re.compile(r"\s*(?:…|\.{3,})$")
_BREAK, _LETTER = re.compile(r"(?<=[.!?])\s+|\n+"), re.compile(r"\w")
#: Novel bytes up to which a reply is a copy.
COPY_BYTES = 18
#: A reply whose chance to end there is under this is truncated.
END_CHANCE = 0.12
_CONTEXT, _SMOOTH, _RARE, _SHORT = 4, 0.7, 3, 12
#: Rows of a batch that is counted at once.
_ROWS = 5000


def is_empty(reply: str | None) -> bool:
    """True for null, blanks, marks without a letter or digit, markup without text, and placeholders."""
    if reply is None:
        return True
    if len(reply) > 60 and _LETTERS.search(reply) and "<" not in reply:
        return False
    text = re.sub(r"<[^<>]*>|&nbsp;", " ", reply)
    core = "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in text)
    words = " ".join(core.split()).lower()
    bare = re.sub(r"^[\W_]+|[\W_]+$", "", text.lower())
    if not words:
        return not any(unicodedata.category(c) == "So" for c in text)
    return bare in PLACEHOLDERS or words in PLACEHOLDERS or words == "n a"


def plain(text: str) -> str:
    return _SPACE.sub(" ", text.lower()).strip()


_LEAD_BYTES = (" ".join(plain(x) for x in LEADS) + " ").encode()
_LEAD_WORDS = frozenset(_LEAD_BYTES.decode().split())
_MAGIC = 6
_BLANKS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def _coarse(text: str) -> list[bytes]:
    """Words in lower case; marks beyond ASCII stay with them."""
    return text.lower().encode("utf-8", "replace").translate(_BLANKS).split()


_LEAD_COARSE = frozenset(_coarse(" ".join(LEADS)))


def novel_bytes(prompt: str, reply: str) -> int:
    """Size of the reply, in plain words, when the prompt is already known."""
    import zstandard as z

    p, r = plain(prompt).encode(), plain(reply).encode()
    log = min(27, max(10, (len(p) + len(r) + len(_LEAD_BYTES)).bit_length()))
    setup = z.ZstdCompressionParameters(window_log=log, hash_log=min(log + 1, 17), chain_log=min(log + 1, 17), search_log=3, min_match=4, target_length=64, strategy=z.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
    known = z.ZstdCompressionDict(_LEAD_BYTES + p + b" ", dict_type=z.DICT_TYPE_RAWCONTENT)
    return len(z.ZstdCompressor(compression_params=setup, dict_data=known).compress(r)) - _MAGIC


def is_copy(prompt: str | None, reply: str) -> bool:
    """True if the reply gives most of the prompt back and nothing else. Compression runs where lengths and words allow a copy at all."""
    if not prompt:
        return False
    # Before marks of all kinds are taken off: far too many words of its own.
    own = set(_coarse(reply))
    if 10 * len(own.difference(_coarse(prompt), _LEAD_COARSE)) > 8 * len(own):
        return False
    p, r = plain(prompt), plain(reply)
    if not p or len(r) < 0.7 * len(p) or len(r) < 8:
        return False
    words = set(r.split())
    if 2 * len(words.difference(p.split(), _LEAD_WORDS)) > len(words):
        return False
    return novel_bytes(prompt, reply) <= COPY_BYTES


def is_refusal(reply: str) -> bool:
    """True if every sentence after the greeting is a refusal; a contact hint after a semicolon or comma belongs to it.

    The first sentence that isn't one ends the search, so long replies of another kind are cheap.
    """
    core = GREETING.sub("", reply.strip().replace("’", "'"), count=1)
    at, any_part = 0, False
    for end, start in itertools.chain((m.span() for m in _BREAK.finditer(core)), [(len(core), len(core))]):
        if _LETTER.search(core, at, end):
            any_part = True
            if not REFUSAL.search(core, at, end):
                return False
        at = start
    return any_part


class Languages:
    """Word dictionaries per language: the seeds, or those grown from them."""

    def __init__(self, words: dict[bytes, str] | None = None) -> None:
        if words is None:
            each = {lang: {x for w in SEEDS[lang].split() for x in _coarse(w)} for lang in LANGS}
            words = {w: lang for lang in LANGS for w in each[lang] if sum(w in x for x in each.values()) == 1}
        self.words = words

    def of(self, text: str) -> str | None:
        """The language, or None if there are under two words for it or another has a third as many."""
        return self.of_words(_coarse(text))

    def of_words(self, words: list[bytes]) -> str | None:
        votes = Counter(map(self.words.get, words))
        rest = votes.pop(None, 0)
        if not votes:
            return None
        top, n = votes.most_common(1)[0]
        rest = votes.total() - n
        return top if n >= 2 and n > 3 * rest else None


def language_words(counts: DataFrame) -> dict[bytes, str]:
    """The dictionary from (w, lang, n), the texts of each language that hold a word: words eight times commoner in one language than in any other."""
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # one row a language
    if not totals:
        return Languages().words
    rate = F.col("n") / F.element_at(F.create_map(*(F.lit(x) for p in totals.items() for x in (p[0], float(p[1])))), F.col("lang"))
    best = counts.withColumn("rate", rate).groupBy("w").agg(F.sort_array(F.collect_list(F.struct("rate", "lang", "n")), asc=False).alias("x"))  # one struct a language
    second = F.when(F.size("x") > 1, F.col("x")[1]["rate"]).otherwise(0.0)
    picked = best.where((F.col("x")[0]["n"] >= max(5, sum(totals.values()) / VOCABULARY)) & (F.col("x")[0]["rate"] > 8 * second))
    return {bytes(r.w): r.lang for r in picked.select("w", F.col("x")[0]["lang"].alias("lang")).collect()} or Languages().words  # no more than VOCABULARY


# The terminal-context model. Tokens are words in lower case, # for those with a figure, and marks: . for the end of a sentence, , for others, an ellipsis too.
_OPEN = np.uint64(0x5851F42D4C957F2D)
_SEED, _MULTIPLY = 0x2545F4914F6CDD1D, np.uint64(0x9E3779B97F4A7C15)


def _token(w: str) -> str:
    return "," if w in ",;:()" or w[0] == "…" or w[:2] == ".." else "." if _MARK.match(w) else "#" if any(c.isdigit() for c in w) else w


def tokens_of(text: str) -> list[str]:
    return [_token(w) for w in _TOKEN.findall(text.lower())]


class _Codes(dict):
    """Hashes of tokens by their raw text, and the tokens by their hashes; emptied by its user when it is large."""

    def __init__(self) -> None:
        self.names: dict[int, str] = {}

    def __missing__(self, raw: str) -> int:
        token = _token(raw)
        self[raw] = h = _hashed(token)
        self.names[h] = token
        return h


def _hashed(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))


def _chain(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    x = (h ^ word) * _MULTIPLY
    return x ^ (x >> np.uint64(31))


def contexts(words: list[int], whole: bool) -> list[int]:
    """Hashes of the last one to four of a text's words (as hashes), and of all of them as a beginning if there are few."""
    out = []
    for k in range(1, min(_CONTEXT, len(words)) + 1):
        h = np.array([_SEED + k], "u8")
        for w in words[-k:]:
            h = _chain(h, np.array([w], "u8"))
        out.append(int(h[0]))
    if whole:
        h = before = np.array([_SEED], "u8")
        for w in words:
            h, before = _chain(h, np.array([w], "u8")), h
        out += [int(h[0]), int((before ^ _OPEN)[0])]
    return out


def _counted(raw: list[str], codes: _Codes, hashed: Callable[[str], int], asked: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(hash, all, ends) of the contexts of texts that are asked for, and the number of tokens: how often they stand, and how often a sentence (a beginning: the text) ends there.

    A beginning is gone on with inside a word too: a text whose next word is longer counts for it.
    """
    code, dot, comma = codes.__getitem__, hashed("."), hashed(",")
    texts = [list(map(code, _TOKEN.findall(t.lower()))) for t in raw]
    size = np.array([len(t) for t in texts], "i8")
    flat = np.fromiter(itertools.chain.from_iterable(texts), "u8", int(size.sum()))
    first = np.cumsum(size) - size
    place = np.arange(len(flat)) - np.repeat(first, size)
    left = np.repeat(size, size) - place - 1  # tokens after this one
    after = np.r_[flat[1:], np.zeros(1, "u8")]
    is_mark = (flat == dot) | (flat == comma)
    hashes, ends, times = [], [], []
    for k in range(1, _CONTEXT + 1):
        at = np.flatnonzero((place >= k - 1) & (left > 0) & ~is_mark)
        h = np.full(len(at), _SEED + k, "u8")
        for j in range(k - 1, -1, -1):
            h = _chain(h, flat[at - j])
        on = asked(h)
        hashes.append(h[on])
        ends.append(after[at[on]] == dot)
        times.append(np.ones(len(ends[-1]), "i8"))
    h, doc = np.full(len(texts), _SEED, "u8"), np.arange(len(texts))
    for m in range(_SHORT):  # beginnings, a word longer each time
        doc = doc[size[doc] > m]
        open_ = doc[asked(h[doc] ^ _OPEN)]
        both, many = np.unique(np.stack([h[open_], flat[first[open_] + m]], axis=1), axis=0, return_counts=True)
        for (start, word), n in zip(both, many.tolist()):
            w = codes.names[int(word)]
            parts = _chain(np.repeat(start, len(w) - 1), np.array([hashed(w[:j]) for j in range(1, len(w))], "u8"))
            parts = parts[asked(parts)]
            hashes.append(parts)
            ends.append(np.zeros(len(parts), bool))
            times.append(np.full(len(parts), n))
        h[doc] = _chain(h[doc], flat[first[doc] + m])
        over = size[doc] == m + 1
        goes_on = ~over & ~is_mark[np.minimum(first[doc] + m + 1, len(flat) - 1)]
        mine = doc[over | goes_on]
        on = asked(h[mine])
        hashes.append(h[mine[on]])
        ends.append((size[mine] == m + 1)[on])
        times.append(np.ones(len(ends[-1]), "i8"))
    hashes, ends, times = np.concatenate(hashes), np.concatenate(ends), np.concatenate(times)
    value, at = np.unique(hashes, return_inverse=True)
    return value, np.bincount(at, weights=times, minlength=len(value)).astype("i8"), np.bincount(at, weights=ends, minlength=len(value)).astype("i8"), len(flat)


def ends_openly(reply: str) -> tuple[bool, list[str], bool]:
    """(True if a reply is truncated for its last mark alone, the words whose context must tell, whether they may be a reply as a whole).

    No words where the reply ends with a final mark, code or a symbol. An ellipsis is taken off: what stands before it tells.
    """
    t = reply.rstrip()
    bare = _ELLIPSIS.sub("", t)
    if bare != t and bare:
        t = bare.rstrip()
    elif _END.search(t):
        return False, [], False
    if t[-1] in ",(-–—:[{/&+=" or t[-2:] in (" '", ' "'):
        return not t.endswith((":-)", ":-(")), [], False
    if not t[-1].isalnum():
        return False, [], False
    tail = tokens_of(t if len(t) <= 400 else t[-400:].partition(" ")[2])
    short = len(t) < 120 and len(tail) <= _SHORT and t == reply.rstrip()
    return t.rfind("(") > t.rfind(")"), tail if short else tail[-_CONTEXT:], short


def asked_languages(prompt: str) -> set[str]:
    return {_NAMES[w] for w in _WORD.findall(prompt.lower()) if w in _NAMES}


def defect_of(prompt: str | None, reply: str | None, safe: bool, languages: Languages) -> str | None:
    """The defect of one pair apart from truncation, or None; the first that holds of empty, copy, refusal, other_language."""
    if is_empty(reply):
        return "empty"
    if is_copy(prompt, reply):
        return "copy"
    if is_refusal(reply):
        return "refusal" if safe else "none"
    said = languages.of(reply)
    if said and prompt:
        of = languages.of(prompt)
        if of and of != said and said not in asked_languages(prompt):
            return "other_language"
    return None


def chance(seen: list[tuple[int, int]], base: float) -> float:
    """The chance that a sentence ends after some words, from (all, ends) of the last one, two, .. of them, with back-off."""
    p = base
    for n, ends in seen:
        if not n:
            break
        p = (ends + _SMOOTH * p) / (n + _SMOOTH)
    return p


def is_truncated(tail: list[str], short: bool, seen: dict[int, tuple[int, int]], base: float, capital: bool) -> bool:
    """True if a reply that ends openly with these words hardly ends there. seen: (all, ends) by place in `contexts`.

    A word that stands hardly anywhere else is the rest of a word, unless it is a name with a capital letter.
    """
    if not tail:
        return False
    if tail[-1] == ",":
        return True
    levels = [seen.get(k, (0, 0)) for k in range(min(_CONTEXT, len(tail)))]
    n, whole = seen.get(len(levels), (0, 0)) if short else (0, 0)
    if whole >= 2 and whole > n - whole:  # given as a whole elsewhere, and seldom gone on with
        return False
    if tail[-1] != "#" and levels[0][0] < _RARE and not (capital and len(tail[-1]) > 4):
        return True
    return chance(levels, base) < END_CHANCE


def find_defects(df: DataFrame, key: str = "id", prompt: str = "user_message", reply: str = "bot_reply", safe: str = "is_safe", arrived: str = "ingested_at") -> DataFrame:
    """One row per defective pair: key, defect. A key stored several times is judged by its first arrival (ties: smaller hash).

    A null reply is empty; a null prompt leaves only empty, refusal and truncated; is_safe null is taken as not safe.
    Texts of any length are judged whole.
    """
    from quillspark.session import checkpointed

    kind = df.schema[key].dataType.simpleString()
    texts = df.select(F.col(prompt).alias("p"), F.col(reply).alias("r"))
    seeds = Languages()

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words by language, and under an empty language the contexts that open replies ask for."""
        seen: dict[str, Counter] = defaultdict(Counter)
        hashed = functools.lru_cache(1 << 16)(_hashed)

        def full() -> pa.RecordBatch:
            rows = [(w, lang, n) for lang, c in seen.items() for w, n in c.items()]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.string(), pa.int64()))], names=["w", "lang", "n"])

        for b in batches:
            for t in itertools.chain(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t and (lang := seeds.of_words(own := _coarse(t))):
                    seen[lang].update(set(own))
            for t in b.column(1).to_pylist():
                if t and t.strip():
                    _, tail, short = ends_openly(t)
                    if tail:
                        seen[""].update(h.to_bytes(8, "little") for h in contexts([hashed(w) for w in tail], short))
            if sum(map(len, seen.values())) > 200_000:
                yield full()
        yield full()

    counts = checkpointed(texts.mapInArrow(tally, "w binary, lang string, n long").groupBy("w", "lang").agg(F.sum("n").alias("n")))
    words = df.sparkSession.sparkContext.broadcast(language_words(counts.where("lang <> ''")))
    bits, packed = _asked_table(counts.where("lang = ''").select("w"))
    table = df.sparkSession.sparkContext.broadcast(packed)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(table.value, "u1")
        hashed, codes = functools.lru_cache(1 << 17)(_hashed), _Codes()

        def asked(h: np.ndarray) -> np.ndarray:
            slot = h >> np.uint64(64 - bits)
            return (held[(slot >> np.uint64(3)).astype("i8")] >> (slot & np.uint64(7)).astype("u1") & 1).astype(bool)

        for whole in batches:
            for at in range(0, len(whole), _ROWS):
                listed = [t for t in whole.slice(at, _ROWS).column(0).to_pylist() if t and t.strip()]
                if listed:
                    if len(codes) > 1 << 18:
                        codes = _Codes()
                    value, n, ends, size = _counted(listed, codes, hashed, asked)
                    extra = [np.array([0], "u8"), np.array([size]), np.array([len(listed)])]  # tokens and replies
                    yield pa.RecordBatch.from_arrays([pa.array(np.r_[value, extra[0]].view("i8")), pa.array(np.r_[n, extra[1]]), pa.array(np.r_[ends, extra[2]])], names=["h", "n", "ends"])

    found = checkpointed(texts.select("r").mapInArrow(count, "h long, n long, ends long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends")))
    size = found.where("h = 0").select("n", "ends").first()
    base = min(0.5, size.ends / max(1, size.n)) if size else 0.5

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = Languages(words.value)
        hashed = functools.lru_cache(1 << 16)(_hashed)
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for x, y, z in zip(*(b.column(i).to_pylist() for i in (0, 1, 2))):
                d = defect_of(x, y, z == 1, languages)
                sure, tail, short = ends_openly(y) if d is None else (False, [], False)
                capital = bool(tail) and re.split(r"[\W_]+", _ELLIPSIS.sub("", y.rstrip()).rstrip())[-1][:1].isupper()
                for o, v in zip(out, ("truncated" if sure else d, tail, short, capital, [h - (1 << 64) if h >> 63 else h for h in contexts([hashed(w) for w in tail], short)] if tail and not sure else [])):
                    o.append(v)
            types = (pa.string(), pa.list_(pa.string()), pa.bool_(), pa.bool_(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(3), b.column(4), *(pa.array(o, t) for o, t in zip(out, types))], names=["k", "at", "defect", "tail", "short", "capital", "asks"])

    at = F.struct(F.coalesce(F.col(arrived).cast("timestamp").cast("double"), F.lit(math.inf)).alias("t"), F.xxhash64(prompt, reply, safe).alias("h"))
    judged = df.where(F.col(key).isNotNull()).select(F.col(prompt).alias("p"), F.col(reply).alias("r"), F.col(safe).cast("int").alias("s"), F.col(key).alias("k"), at.alias("at"))
    judged = judged.mapInArrow(judge, f"k {kind}, at struct<t: double, h: bigint>, defect string, tail array<string>, short boolean, capital boolean, asks array<bigint>")
    first = checkpointed(judged.groupBy("k").agg(F.min_by(F.struct("defect", "tail", "short", "capital", "asks"), "at").alias("x")).select("k", "x.*").where("(defect is not null and defect <> 'none') or size(asks) > 0"))
    # Counts come to the replies that ask for them; a context that very many ask for is split by the join's own handling of skew after a partial distinct.
    asks = first.where("size(asks) > 0")
    each = asks.select("k", F.posexplode("asks").alias("place", "h")).hint("merge").join(found.hint("merge"), "h").groupBy("k").agg(F.collect_list(F.struct("place", "n", "ends")).alias("seen"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = [is_truncated(t, s, {y["place"]: (y["n"], y["ends"]) for y in x or ()}, base, c) for t, s, c, x in zip(*(b.column(i).to_pylist() for i in range(1, 5)))]
            keep = pa.array(d, pa.bool_())
            ids = b.column(0).filter(keep)
            yield pa.RecordBatch.from_arrays([ids, pa.array(["truncated"] * len(ids), pa.string())], names=["k", "defect"])

    open_ = asks.hint("merge").join(each.hint("merge"), "k", "left").select("k", "tail", "short", "capital", "seen").mapInArrow(settle, f"k {kind}, defect string")
    return first.where("size(asks) = 0").select("k", "defect").unionAll(open_).select(F.col("k").alias(key), "defect")


def _asked_table(hashes: DataFrame) -> tuple[int, bytes]:
    """(bits, packed) of a table with the slots of the hashes (8 bytes each) set; pages of it are made in tasks."""
    n = hashes.count()
    bits = min(MOST_BITS, max(16, (ASKED_BITS * n).bit_length()))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot = np.frombuffer(b"".join(b.column(0).to_pylist()), "u8") >> np.uint64(64 - bits)
            yield pa.RecordBatch.from_arrays([pa.array((slot >> np.uint64(13)).astype("i8")), pa.array((slot & np.uint64(8191)).astype("i4"))], names=["page", "slot"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(1).to_pylist():
                page = np.zeros(8192, "u1")
                page[x] = 1
                out.append(np.packbits(page, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["page", "x"])

    packed = bytearray((1 << bits) // 8)
    pages = hashes.mapInArrow(slots, "page long, slot int").distinct().groupBy("page").agg(F.collect_list("slot").alias("x"))  # at most 8192 slots a page
    for r in pages.mapInArrow(pack, "page long, x binary").collect():  # 1 KB each, no more than the table: 16 MB
        packed[r.page * 1024 : (r.page + 1) * 1024] = r.x
    return bits, bytes(packed)
