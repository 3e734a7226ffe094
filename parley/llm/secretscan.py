"""Secret scanning: candidate strings, then a random forest that removes false positives."""

from __future__ import annotations

import functools
import hashlib
import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import forest
from parley.llm import kernels as K

#: Labelled findings that the forest learns from, and the score from which a candidate is a secret.
FINDINGS, THRESHOLD = 3000, 0.5
REPLACEMENT = "[SECRET]"
#: Characters on either side of a candidate that its neighbouring words are taken from.
CONTEXT = 48
#: Words that name a secret, words that name something else, and a small dictionary.
KEY_WORDS = frozenset("access api apikey auth authorization aws bearer client credential credentials key passphrase passwd password private pwd secret session sk token".split())
OTHER_WORDS = frozenset("build checksum commit digest dummy etag example fake file guid hash id image isbn issue md5 order page phone placeholder ref request revision sample serial sha sha1 sha256 sum test trace tracking uuid version".split())
DICTIONARY = frozenset("about account admin after again also application array based before between business change class client code color common company config content control count create customer data database date default delete design detail develop different display document domain dummy each element email enable error event every example export field file filter first format from function general get global group have header height help home host image import index info input insert install int international internet item java json last length level library line link list load local location login long main make manage many map market media member message method mobile model module more most name network news next node note number object only open option order other output package page parameter parent password path people place platform play point policy post print private process product profile program project property provider public query question range read record release remote report request research resource response result return review role root sample save script search secret section security select send server service session set show side sign simple single site size software some source space start state status stop store string style system table target team template test text that their them then there these they this time title token tool type under update upload user using valid value version video view web website well when where which width will window with word work world would write year your".split())

_KEY_BEGIN = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY(?: BLOCK)?-----")
_KEY_END = re.compile(r"-----END [A-Z ]*PRIVATE KEY(?: BLOCK)?-----")
#: Headers, an empty line and whole lines of base64 after a BEGIN line that has no END line.
_LINE = r"[ \t]*(?:\r?\n|\\n)"
_KEY_BODY = re.compile(rf"(?:{_LINE}(?:Proc-Type|DEK-Info|Version|Comment|Charset|Hash):[^\n\\]*)*+(?:{_LINE}(?={_LINE}))?+(?:{_LINE}[A-Za-z0-9+/=]++(?={_LINE}|[ \t]*\Z))*+")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_.-]{16,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?")
#: A name with or without quotes, an assignment or an authorization scheme, and a value with or without quotes.
_ASSIGNED = re.compile(
    r"(?:(?:pass(?:word|wd|phrase)?|pwd|secret|token|credentials?|(?:(?<![a-z])|api|access|private|secret|auth|account|client|master|signing|encryption)[_-]?key)[\"']?[ \t]*(?:=>|:=|[:=])"
    r"|authorization[\"']?[ \t]*[:=][ \t]*[\"']?(?:bearer|basic|token)(?=[ \t]))"
    r"[ \t]*[\"']?(?P<value>(?<=\")[^\s\"]{8,}|(?<=')[^\s']{8,}|(?<![\"'])[^\s\"']{8,})",
    re.I,
)
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[A-Za-z][A-Za-z0-9]*")
_PREFIX = re.compile(r"^(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk-|sk_live_|rk_live_|AIza|ya29|eyJ|npm_|SG\.|hf_|-----BEGIN)")
_UUID = re.compile(r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")
_HEX = re.compile(r"^[0-9a-fA-F]+$")
FEATURES = ("length", "digits", "upper", "lower", "other", "class_changes", "distinct", "entropy", "letter_pairs", "vowels", "dictionary", "hex", "uuid", "known_prefix", "assigned", "quoted", "key_words_before", "other_words_before", "other_words_after", "path_test", "in_url", "dots")


def _class(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


def coverage(value: str) -> float:
    """Share of characters in dictionary words of four letters or more, longest first from the left."""
    low, i, hit = value.lower(), 0, 0
    while i < len(low):
        for n in range(min(14, len(low) - i), 3, -1):
            if low[i : i + n] in DICTIONARY:
                hit, i = hit + n, i + n
                break
        else:
            i += 1
    return hit / max(1, len(low))


def describe(value: str, before: str, after: str, path: str) -> list[float]:
    """Features of a candidate: its characters, the path it is found in and the words around it.

    The words around it are the last three before it and those that begin in the 24 characters
    before it, and the first four after it; ``before`` and ``after`` are CONTEXT characters at most.
    """
    n = len(value)
    classes = [_class(c) for c in value]
    many = Counter(value)
    pairs = sum(a.isalpha() and b.isalpha() for a, b in zip(value, value[1:], strict=False))
    left = [w.lower() for w in _WORD.findall(before)][-6:]
    right = [w.lower() for w in _WORD.findall(after)][:4]
    near = {p for w in re.findall(r"[A-Za-z]+", before[-24:].replace("_", " ")) for p in (w.lower(),)}
    path_words = {w.lower() for w in re.findall(r"[A-Za-z]+", path)}
    share = [classes.count(k) / n for k in range(4)]
    return [
        float(n),
        *share,
        sum(a != b for a, b in zip(classes, classes[1:], strict=False)) / max(1, n - 1),
        len(many) / n,
        -sum(c / n * math.log2(c / n) for c in many.values()),
        pairs / max(1, n - 1),
        sum(c in "aeiouAEIOU" for c in value) / n,
        coverage(value),
        float(bool(_HEX.match(value))),
        float(bool(_UUID.match(value))),
        float(bool(_PREFIX.match(value))),
        float(bool(re.search(r"[:=]\s*[\"']?$", before))),
        float(before[-1:] in "\"'" and before[-1:] != ""),
        float(len(KEY_WORDS & (set(left[-3:]) | near))),
        float(len(OTHER_WORDS & (set(left[-3:]) | near))),
        float(len(OTHER_WORDS & set(right))),
        float(bool(path_words & {"test", "tests", "example", "examples", "mock", "fixture", "fixtures", "doc", "docs", "sample"})),
        float("://" in before[-40:] or "://" in value or "/" in value and value.count("/") > 1 and "." in value),
        value.count(".") / n,
    ]


def key_blocks(text: str) -> list[tuple[int, int]]:
    """Spans of private keys of any length; one without an END line before the next BEGIN goes as far as its body."""
    begins, ends = list(_KEY_BEGIN.finditer(text)), [m.end() for m in _KEY_END.finditer(text)]
    spans, k = [], 0
    for i, begin in enumerate(begins):
        while k < len(ends) and ends[k] <= begin.end():
            k += 1
        limit = begins[i + 1].start() if i + 1 < len(begins) else len(text)
        closed = k < len(ends) and ends[k] <= limit
        spans.append((begin.start(), ends[k] if closed else _KEY_BODY.match(text, begin.end(), limit).end()))
    return spans


def candidates(text: str) -> Iterator[tuple[int, str, str, str]]:
    """Start, value, and the text before and after, of each candidate.

    Candidates are private keys, assigned values of 8 characters or more, and runs of 16 characters
    or more that have a digit or a known prefix: what is shorter is no candidate, as words and
    numbers of that length are everywhere. Values of any length are taken whole. They come by start,
    each span once; those of different kinds may overlap.
    """
    blocks = key_blocks(text)
    spans = set(blocks)
    for match in _ASSIGNED.finditer(text):
        start, end = match.span("value")
        if text[start - 1] not in "\"'":  # without quotes a value may be followed by punctuation
            end = max(start + 8, start + len(text[start:end].rstrip(".,;:)]}>")))
        spans.add((start, end))
    at = 0
    for match in _RUN.finditer(text):
        start, value = match.start(), match.group()
        if not (_DIGIT.search(value) or _PREFIX.match(value)):
            continue
        while at < len(blocks) and blocks[at][1] <= start:
            at += 1
        if at < len(blocks) and blocks[at][0] <= start:
            continue
        stripped = value.rstrip(".-/")
        spans.add((start, start + len(stripped if len(stripped) >= 8 else value)))
    for start, end in sorted(spans):
        yield start, text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]


def labelled_texts(n: int = FINDINGS, seed: int = 5) -> Iterator[tuple[str, str, str, str, int]]:
    """Value, text before and after, path and label of ``n`` findings: half secrets, half strings that look like them.

    The findings are made here by rule: keys, tokens and passwords in assignments and headers of
    either case, against hashes, ids, numbers, paths, version strings, references to variables and
    words around prose.
    """
    rng = np.random.default_rng(seed)

    def pick(options):
        return options[int(rng.integers(len(options)))]

    def chars(alphabet: str, size: int) -> str:
        return "".join(alphabet[int(i)] for i in rng.integers(len(alphabet), size=size))

    hexes, letters = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"
    both = letters + letters.upper() + "0123456789"
    words = sorted(DICTIONARY)

    def prose(size: int) -> str:
        return " ".join(pick(words) if rng.random() < 0.5 else "".join(pick(("th", "er", "on", "an", "ch", "en", "ou", "ie", "es", "ti")) for _ in range(int(rng.integers(1, 5)))) for _ in range(size))

    def secret() -> tuple[str, str, str]:
        kind = int(rng.integers(8))
        if kind == 7:
            lines = [chars(both + "+/", 64) for _ in range(int(rng.integers(4, 60)))]
            if rng.random() < 0.5:
                begin = pick(("", "RSA ", "EC ", "OPENSSH ")) + "PRIVATE KEY-----"
                return f"-----BEGIN {begin}\n" + "\n".join(lines) + f"\n-----END {begin}", prose(4) + pick((" ", "\n", ' key = "')), pick(("\n", '"')) + prose(3)
            return "".join(lines)[: int(rng.integers(200, 3000))], prose(4) + " " + pick((' password = "', " token: '", ' "secret": "')), '"' + prose(3)
        if kind < 2:
            value = chars(hexes, int(pick((32, 40, 40, 48, 64))))
        elif kind == 2:
            value = pick(("AKIA", "ASIA")) + chars(letters.upper() + "234567", 16)
        elif kind == 3:
            value = pick(("ghp_", "sk-", "xoxb-", "glpat-", "npm_", "AIza", "sk_live_")) + chars(both, int(rng.integers(20, 41)))
        elif kind == 4:
            value = chars(both + "+/", int(rng.integers(24, 65))) + pick(("", "=", "=="))
        elif kind == 5:
            value = "eyJ" + chars(both, 20) + "." + chars(both, 40) + "." + chars(both + "-_", 43)
        else:
            value = chars(both + "!@#%^&*", int(rng.integers(10, 24)))
        name = pick(("token", "secret", "password", "api_key", "apikey", "auth_token", "access_key", "client_secret", "private_key", "key", "SECRET_KEY", "credentials"))
        lead = pick((f'{name} = "', f"{name}: '", f"{name}=", f"{name} = ", f'"{name}": "', f"export {name.upper()}=", "Authorization: Bearer "))
        if kind in (2, 3) and rng.random() < 0.4:
            lead = prose(1) + " "
        tail = '"' if '"' in lead[-1:] else "'" if "'" in lead[-1:] else " "
        return value, prose(4) + " " + lead, tail + prose(3)

    def other() -> tuple[str, str, str]:
        kind = int(rng.integers(11))
        if kind == 10:
            word = pick(words)
            return pick(("${%s_%s}", "{{%s.%s}}", "$(%s_%s)", "%%(%s_%s)s", "%s.get(%s)", "<%s-%s>")) % ((word, pick(words)) if rng.random() < 0.5 else (word.upper(), pick(words).upper())), prose(3) + pick((" token=", " password: ", ' secret = "', " API_KEY=", " key: ")), pick(('"', " ")) + prose(3)
        if kind == 0:
            return chars("0123456789", int(rng.integers(16, 25))), prose(5) + " ", " " + prose(3)
        if kind == 1:
            return str(uuid.UUID(bytes=rng.bytes(16))), prose(3) + pick((" id: ", " request ", " uuid=", " trace id ")), " " + prose(3)
        if kind == 2:
            return hashlib.sha1(rng.bytes(8)).hexdigest(), prose(3) + pick((" commit ", " sha1: ", " revision ", ' etag: "', " checksum=")), pick((" ", '" ')) + prose(3)
        if kind == 3:
            return pick(("src", "lib", "usr", "docs")) + "/" + "/".join(pick(words) for _ in range(3)) + f"/v{int(rng.integers(9))}.{pick(('html', 'py', 'txt'))}", prose(4) + pick((" ", " https://")), " " + prose(3)
        if kind == 4:
            return f"{pick(words)}_{pick(words)}_{pick(words)}_{int(rng.integers(99))}", prose(4) + pick((" ", " = ", " version ")), " " + prose(3)
        if kind == 5:
            return f"20{int(rng.integers(10, 30))}-0{int(rng.integers(1, 9))}-1{int(rng.integers(9))}T12-{int(rng.integers(10, 59))}-00Z", prose(4) + " date: ", " " + prose(3)
        if kind == 6:
            return pick(("your", "my", "example", "changeme", "dummy")) + pick(("-token-here", "_password_123", "-api-key-1234", "_secret_value1")), prose(3) + pick((' token = "', " password: '", ' api_key = "')), pick(('"', "'")) + prose(2)
        if kind == 7:
            return f"{int(rng.integers(99))}.{pick(words)}.{pick(words)}{int(rng.integers(9))}.example.com", prose(4) + " ", " " + prose(3)
        if kind == 8:
            return "x" * int(rng.integers(8, 33)) + str(int(rng.integers(10))), prose(3) + pick((' key = "', ' token = "')), '"' + prose(2)
        return "".join(pick(("th", "er", "on", "an", "ch", "en", "ou", "ie")) for _ in range(9)) + str(int(rng.integers(99))), prose(5) + " ", " " + prose(3)

    for i in range(n):
        value, before, after = secret() if i % 2 else other()
        if rng.random() < 0.15 and i % 2 and not _PREFIX.match(value):
            value, before = value.upper(), before.upper()
        path = pick(("src/app.py", "config/prod.env", "src3", "notes.txt")) if i % 2 or rng.random() < 0.7 else pick(("tests/test_auth.py", "docs/example.md"))
        yield value, before, after, path, i % 2


def labelled_findings(n: int = FINDINGS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of ``n`` findings."""
    made = list(labelled_texts(n, seed))
    return np.array([describe(value, before[-CONTEXT:], after[:CONTEXT], path) for value, before, after, path, _ in made]), np.array([m[4] for m in made])


@functools.cache
def trained() -> forest.Forest:
    """The forest of the labelled findings above."""
    return forest.grow(*labelled_findings())


def findings_in(texts: list[str], paths: list[str], model: forest.Forest) -> tuple[list[tuple[int, int, str, str, str]], np.ndarray]:
    """Candidates of several texts (text, start, value, before, after) and their scores."""
    found = [(i, *c) for i, text in enumerate(texts) for c in candidates(text)]
    if not found:
        return [], np.zeros(0)
    rows = np.array([describe(value, before, after, paths[i]) for i, _, value, before, after in found])
    return found, model.predict(rows)


def _input(docs: DataFrame) -> DataFrame:
    path = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    return docs.select(F.col("doc_id").cast("long"), "text", path.alias("path"))


def scan(docs: DataFrame, model: forest.Forest | None = None) -> DataFrame:
    """Every candidate of every whole text with the forest's verdict.

    Returns doc_id, start (characters before it), value, score and is_secret, which is
    score >= THRESHOLD. ``source``, if docs has it, is the path that a text was found in. A null or
    empty text has no candidates, a very long one is scanned whole. Repeated rows give their
    candidates each, and a null id keeps its null; a score of exactly THRESHOLD is a secret. An empty
    table gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in K.blocks(batch):
                ids = block.column(0).to_pylist()
                found, score = findings_in(K.fill(block.column(1)).to_pylist(), K.fill(block.column(2)).to_pylist(), shared.value)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([ids[f[0]] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.string()), pa.array(score), pa.array(score >= THRESHOLD)], ["doc_id", "start", "value", "score", "is_secret"])

    return K.map_batches(_input(docs), run, "doc_id long, start long, value string, score double, is_secret boolean")


def redact(docs: DataFrame, model: forest.Forest | None = None) -> DataFrame:
    """docs with every secret in ``text`` replaced by REPLACEMENT; rows and other columns stay as they are.

    Secrets are the candidates that ``scan`` marks; those that overlap are replaced as one, those that
    touch one by one. Null and empty texts stay as they are, very long ones are searched whole. A null
    ``source`` is an empty path. Repeated rows change alike, and an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or trained())
    names = docs.columns
    at = names.index("text")
    path_at = names.index("source") if "source" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in K.blocks(batch):
                texts = block.column(at).to_pylist()
                paths = ["" if p is None else str(p) for p in block.column(path_at).to_pylist()] if path_at is not None else [""] * len(texts)
                found, score = findings_in([t or "" for t in texts], paths, shared.value)
                spans: list[list[int]] = []  # secrets that overlap are one
                for (i, start, value, *_), s in zip(found, score, strict=True):
                    if s >= THRESHOLD:
                        if spans and spans[-1][0] == i and start < spans[-1][2]:
                            spans[-1][2] = max(spans[-1][2], start + len(value))
                        else:
                            spans.append([i, start, start + len(value)])
                for i, start, end in reversed(spans):  # from the last, so that places stay right
                    texts[i] = texts[i][:start] + REPLACEMENT + texts[i][end:]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else block.column(k) for k in range(len(names))], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return K.map_batches(docs, run, schema)
