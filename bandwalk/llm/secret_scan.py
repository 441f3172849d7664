"""Secret scan: candidate strings, judged by a random forest that removes false positives.

Candidates are long unbroken strings with digits, and whatever follows a name with a secret
word in it, of any length and in any characters.  Features are the candidate's length, how
likely its character transitions are in ordinary text, how much of it common words cover,
entropy and alphabet, whether it looks like a path, and the words before and after it.
The forest is trained on labelled findings: strings of known kinds in known surroundings.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words next to secrets, and next to look-alikes (fixed values).
SECRET_WORDS = ("password", "passwd", "pwd", "token", "secret", "api", "apikey", "key", "auth", "bearer", "credential", "private", "access")
HARMLESS_WORDS = ("commit", "sha", "sha1", "sha256", "md5", "checksum", "digest", "hash", "uuid", "guid", "etag", "revision", "version", "build", "image", "file", "path", "id", "isbn", "order", "integrity", "session")
#: Common words and name parts that cover harmless identifiers (fixed values).
DICTIONARY = ("the", "and", "ing", "tion", "ent", "ver", "con", "com", "pro", "int", "data", "test", "file", "name", "user", "time", "page", "index", "image", "video", "release", "version", "build", "config", "example", "sample", "content", "update", "default", "report", "section", "chapter", "volume", "number", "table", "figure", "value", "model", "class", "string", "array", "object", "event", "state", "server", "client", "local", "public", "static", "assets", "src", "lib", "main", "http", "https", "www", "html", "json", "node", "module", "package")
CANDIDATE = re.compile(rb"[A-Za-z0-9_+/.\-]{12,}+(?:={1,2}(?![A-Za-z0-9_+/\-]))?")
#: After a name: an operator, or white space alone; then what may open a value.
_GIVEN = re.compile(rb"[\"'`\])]{0,2}(?:(\s*+[=:>]{1,3}\s*+)|\s++(?:(?:is|was)\b\s*+[=:]?\s*+)?)([\"'`(\[{]?)")
#: A value without quotes ends at white space, a quote, a closing tag or the next assignment.
_VALUE = re.compile(rb"(?:[^\s\"'`;,&<]|[;,&](?![A-Za-z0-9_.\-]++[=:])|<(?!/))++")
_NAME = re.compile(rb"[A-Za-z0-9_.\-]*+")
_STEMS = (b"passw", b"pwd", b"token", b"secret", b"api", b"key", b"auth", b"bearer", b"credential", b"private", b"access")
_PART = re.compile(rb"[A-Za-z0-9]+")
_DIGIT, _LETTER = re.compile(rb"[0-9]"), re.compile(rb"[A-Z_a-z]")
FEATURES = ("length", "transition", "dictionary", "entropy", "digits", "upper", "lower", "hex", "classes", "slashes", "dots", "dashes", "before_secret", "before_harmless", "after_harmless", "assigned", "quoted", "runs", "named", "names", "symbols", "spaces")
TREES, DEPTH, SEED = 40, 9, 11
ALPHABET = "abcdefghijklmnopqrstuvwxyz"


def transition_table() -> np.ndarray:
    """Log-probabilities of the next character class, 28 by 28, from the dictionary and neighbour words."""
    count = np.full((28, 28), 0.3)
    for w in (*DICTIONARY, *SECRET_WORDS, *HARMLESS_WORDS):
        k = codes(w)
        np.add.at(count, (k[:-1], k[1:]), 1)
    return np.log(count / count.sum(1, keepdims=True))


def codes(s: str) -> np.ndarray:
    """Letters 0-25, digits 26, all else 27."""
    b = np.frombuffer(s.lower().encode("latin-1", "replace"), np.uint8)
    out = np.full(len(b), 27)
    letter, digit = (b >= 97) & (b <= 122), (b >= 48) & (b <= 57)
    out[letter], out[digit] = b[letter] - 97, 26
    return out


_TABLE = transition_table()
_WORD = re.compile(r"[A-Za-z0-9]+")
_COVER = re.compile("|".join(sorted(DICTIONARY, key=len, reverse=True)))
_NAMED = re.compile(r"(?:" + "|".join(SECRET_WORDS) + r")[\w.\-]*+[\"'`\])]{0,2}\s*+[=:>]{1,3}\s*+[\"'`(\[{]?$", re.IGNORECASE)
_NAMES = re.compile(r"[\"'`\])]{0,2}\s*[=:]\s*\S")


def candidate_features(text: str, before: str, after: str) -> list[float]:
    """FEATURES of one candidate with up to 60 characters on either side."""
    n = len(text)
    k = codes(text)
    share = np.unique(list(text), return_counts=True)[1] / n
    left, right = [w.lower() for w in _WORD.findall(before)[-4:]], [w.lower() for w in _WORD.findall(after)[:3]]
    covered = sum(len(m) for m in _COVER.findall(text.lower()))
    upper, lower, digit = (sum(f(c) for c in text) for f in (str.isupper, str.islower, str.isdigit))
    gap = before.rstrip("\"' ")
    return [
        float(n),
        float(_TABLE[k[:-1], k[1:]].mean()) if n > 1 else 0.0,
        covered / n,
        float(-(share * np.log2(share)).sum()),
        digit / n,
        upper / n,
        lower / n,
        float(all(c in "0123456789abcdefABCDEF" for c in text)),
        float((upper > 0) + (lower > 0) + (digit > 0)),
        float(text.count("/")),
        float(text.count(".")),
        float(text.count("-")),
        float(any(w in SECRET_WORDS for w in left)),
        float(any(w in HARMLESS_WORDS for w in left)),
        float(any(w in HARMLESS_WORDS for w in right)),
        float(gap.endswith(("=", ":"))),
        float(before.endswith(("\"", "'"))),
        float(len(re.findall(r"[A-Z]+|[a-z]+|[0-9]+", text))) / n,
        float(_NAMED.search(before) is not None),
        float(_NAMES.match(after) is not None),
        1 - (upper + lower + digit) / n,
        float(sum(map(str.isspace, text))),
    ]


def labelled_findings(n: int = 3000, seed: int = SEED) -> tuple[list[tuple[str, str, str]], np.ndarray]:
    """Findings (text, before, after) of known kinds with their labels."""
    rng = np.random.default_rng(seed)
    pick = lambda letters, k: "".join(rng.choice(list(letters), k))
    digits, hexes, upper = "0123456789", "0123456789abcdef", ALPHABET.upper()
    b64 = ALPHABET + upper + digits
    plain = lambda: " ".join(pick(ALPHABET, int(rng.integers(2, 9))) for _ in range(6))
    word = lambda: str(rng.choice(DICTIONARY))
    rows, y = [], []
    for i in range(n):
        before, after = plain() + " ", " " + plain()
        name = str(rng.choice(SECRET_WORDS))
        given = str(rng.choice([f"{name} = \"", f"{name}=", f"{name}: ", f"{name}='", f"{name} ", f"{name.upper()}=", f"x-{name}: \""]))
        other = str(rng.choice(HARMLESS_WORDS)) + str(rng.choice([" ", ": ", "=", " is ", " = \""]))
        kind = i % 22
        secret = kind < 7 or 14 <= kind < 18
        marks = "!@#$%^&*?~+-_"
        full = f"{pick(ALPHABET, int(rng.integers(0, 5)))}{rng.choice(['', '_', '.', '-'])}{name}{rng.choice(['', '_2', '-id', '.main', '_V3'])}"
        full = full.upper() if rng.random() < 0.4 else full
        set_to = full + str(rng.choice(["=", ": ", " = \"", "='", ":", "\": \"", " => \""]))
        if kind == 0:
            rows.append(("AKIA" + pick(upper + "234567" + digits, 16), before + str(rng.choice(["", given])), after))
        elif kind == 1:
            rows.append((pick(hexes, int(rng.choice([16, 18, 20, 24, 32, 40, 64]))), before + given, after))
        elif kind == 2:
            rows.append((pick(b64 + "+/", int(rng.integers(20, 60))), before + given, after))
        elif kind == 3:
            rows.append((str(rng.choice(["ghp_", "gho_", "sk_live_", "xoxb-", "glpat-"])) + pick(b64, int(rng.integers(20, 40))), before + str(rng.choice(["", given])), after))
        elif kind == 4:
            rows.append((pick(b64 + "_-", int(rng.integers(14, 28))), before + given, after))
        elif kind == 5:
            rows.append(("eyJ" + pick(b64, 20) + "." + pick(b64, 30) + "." + pick(b64, 24), before + given, after))
        elif kind == 6:
            rows.append((pick(hexes, 18), before + given, after))
        elif kind == 7:
            rows.append((pick(hexes, int(rng.choice([32, 40, 64]))), before + other, after))
        elif kind == 8:
            u = pick(hexes, 32)
            rows.append((f"{u[:8]}-{u[8:12]}-{u[12:16]}-{u[16:20]}-{u[20:]}", before + str(rng.choice(["", other])), after))
        elif kind == 9:
            rows.append(("/".join([word(), word() + pick(digits, 2), word(), word() + "." + word()]), before + str(rng.choice(["", other])), after))
        elif kind == 10:
            rows.append((word().title() + word().title() + word() + pick(digits, int(rng.integers(1, 4))), before + str(rng.choice(["", other])), after))
        elif kind == 11:
            rows.append((f"{word()}-{word()}-{pick(digits, 4)}-{word()}", before, after))
        elif kind == 12:
            rows.append((f"{pick(digits, 4)}-{pick(digits, 2)}-{pick(digits, 2)}T{pick(digits, 6)}", before + str(rng.choice(["", other])), after))
        elif kind == 13:
            rows.append((pick(ALPHABET[:6], 2) * 7 + pick(digits, 2), before + str(rng.choice(["", other, given])), after))
        elif kind == 14:  # short passwords of letters, digits and marks
            rows.append(("".join(rng.permutation(list(pick(b64, int(rng.integers(3, 10))) + pick(digits, 2) + pick(marks, int(rng.integers(0, 3)))))), before + set_to, after))
        elif kind == 15:  # words with digits or marks
            rows.append((str(rng.choice([pick(ALPHABET, int(rng.integers(4, 9))), word().title()])) + pick(marks + digits, int(rng.integers(1, 5))), before + set_to, after))
        elif kind == 16:  # after names of any form
            rows.append((pick(str(rng.choice([hexes, b64, b64 + "+/"])), int(rng.integers(12, 60))), before + set_to, after))
        elif kind == 17:  # long blobs
            rows.append((str(rng.choice(["", "eyJ"])) + pick(str(rng.choice([hexes, b64, b64 + "+/", b64 + "_-."])), int(rng.integers(300, 1500))), before + str(rng.choice([given, set_to])), after))
        elif kind == 18:  # prose and placeholders after a secret name
            held = [pick(ALPHABET, int(rng.integers(1, 10))), pick(ALPHABET, int(rng.integers(2, 9))).title(), "null", "None", "true", "false", "required", "optional", "string", "********", "xxxxxxxx", "<" + name + ">", "${" + name.upper() + "}", "your_" + name, "{{" + word() + "}}", "os.environ", "...", "-", pick(digits, 1), word()]
            rows.append((str(rng.choice(held)), before + str(rng.choice([set_to, given, name + " "])), after))
        elif kind == 19:  # names themselves
            rows.append((full + "_" + pick(ALPHABET, 5) + pick(digits, int(rng.integers(1, 3))), before, str(rng.choice(["=", ": ", " = \""])) + pick(b64, 20)))
        elif kind == 20:  # sentences in quotes
            rows.append((" ".join(pick(ALPHABET, int(rng.integers(2, 9))) for _ in range(int(rng.integers(2, 12)))), before + str(rng.choice([set_to, given])), "\"" + after))
        else:  # words after a secret word without an operator
            rows.append((pick(ALPHABET, int(rng.integers(1, 12))) + str(rng.choice(["", ",", ".", ":", "s", "-" + pick(ALPHABET, 4)])), before + name + " ", after))
        y.append(secret)
    return rows, np.array(y)


class Forest:
    """Binary trees in arrays: feature, threshold, children and the share of secrets in a leaf."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.trees = [self._grow(x, y.astype(float), rng.integers(0, len(x), len(x)), depth, rng) for _ in range(trees)]

    def _grow(self, x, y, rows, depth, rng):
        nodes: list = []

        def split(rows, left) -> int:
            at = len(nodes)
            nodes.append(None)
            p = y[rows].mean()
            best = None
            if left and len(rows) >= 6 and 0 < p < 1:
                for f in rng.choice(x.shape[1], 5, replace=False):
                    v = x[rows, f]
                    for t in np.unique(np.quantile(v, (0.1, 0.25, 0.4, 0.5, 0.6, 0.75, 0.9))):
                        low = v <= t
                        k = low.sum()
                        if 2 <= k <= len(rows) - 2:
                            a, b = y[rows[low]].mean(), y[rows[~low]].mean()
                            g = (k * a * (1 - a) + (len(rows) - k) * b * (1 - b)) / len(rows)
                            if best is None or g < best[0]:
                                best = (g, int(f), float(t), low)
            if best is None or best[0] >= p * (1 - p) - 1e-9:
                nodes[at] = (-1, 0.0, 0, 0, float(p))
                return at
            _, f, t, low = best
            nodes[at] = (f, t, split(rows[low], left - 1), split(rows[~low], left - 1), float(p))
            return at

        split(rows, depth)
        return tuple(np.array(c) for c in zip(*nodes, strict=True))

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, low, high, share in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                go = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= threshold[at]
                at = np.where(inner, np.where(go, low[at], high[at]), at)
            total += share[at]
        return total / max(1, len(self.trees))


def train(n: int = 3000, seed: int = SEED) -> Forest:
    rows, y = labelled_findings(n, seed)
    return Forest(np.array([candidate_features(*r) for r in rows]), y)


def _secret_names(raw: bytes):
    """Ends of the names that hold a secret word, and whether the word is a whole part of the name."""
    low, hits = raw.lower(), []
    for stem in _STEMS:
        at = low.find(stem)
        while at >= 0:
            hits.append(at)
            at = low.find(stem, at + len(stem))
    done = -1
    for at in sorted(hits):
        if at < done:
            continue
        done = _NAME.match(low, at).end()
        start = at
        while start and _NAME.fullmatch(low, start - 1, start) and low[start - 1 : start]:
            start -= 1
        yield at, done, any(w.decode("latin-1") in SECRET_WORDS for w in _PART.findall(low, start, done))


def _given(raw: bytes) -> list[tuple[int, int]]:
    """Spans of what follows a secret name.

    A value that holds further assignments counts whole, and each of those to the next.
    """
    spans, outer, nested = [], 0, None
    for at, end, whole in _secret_names(raw):
        m = _GIVEN.match(raw, end)
        if not m or not (m.group(1) or whole):
            continue
        if m.group(1) and nested is not None and at < outer:
            nested[1] = min(nested[1], at)
        start, opened = m.end(), m.group(2)
        if m.group(1) and start < outer:
            nested = [start, outer]
            spans.append(nested)
            continue
        stop = -1
        if opened in (b"\"", b"'", b"`") and opened:
            line = raw.find(b"\n", start)
            stop = raw.find(opened, start, line if line >= 0 else len(raw))
        if stop < 0:
            v = _VALUE.match(raw, start)
            stop = v.end() if v else start
            outer, nested = (stop, None) if m.group(1) else (outer, nested)
            while stop > start and raw[stop - 1] in b".,;:)]}":
                stop -= 1
        spans.append([start, stop])
    return [(a, b) for a, b in spans if a < b]


def candidates(raw: bytes) -> list[tuple[int, int]]:
    """Spans (start, end) in bytes, which may overlap, in order.

    Strings of 12 or more with a digit and a letter, and values given to a secret name.
    """
    out = set(_given(raw))
    for m in CANDIDATE.finditer(raw):
        x = m.group()
        if _DIGIT.search(x) and _LETTER.search(x):
            end = m.end()
            while end > m.start() and raw[end - 1] in b".-/":
                end -= 1
            if end - m.start() >= 12:
                out.add((m.start(), end))
    return sorted(out)


def _judge(forest: Forest, raw: bytes):
    spans = candidates(raw)
    if not spans:
        return []
    text = lambda a, b: raw[a:b].decode("latin-1")
    x = np.array([candidate_features(text(a, b), text(max(0, a - 60), a), text(b, b + 60)) for a, b in spans])
    return [(a, b, p) for (a, b), p in zip(spans, forest.predict(x), strict=True)]


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ordered spans with overlapping ones joined."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _find(forest: Forest, threshold: float):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids, rows = b.column("doc_id").to_pylist(), []
            for d, t in zip(ids, b.column("text"), strict=True):
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                for start, end, p in _judge(forest, raw):
                    rows.append((d, start, end - start, hashlib.sha256(raw[start:end]).hexdigest(), round(float(p), 6), bool(p >= threshold)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["doc_id", "start", "length", "finding_sha256", "score", "secret"])

    return run


def _redact(forest: Forest, threshold: float, mark: bytes):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            at = b.schema.names.index("text")
            texts = []
            for t in b.column(at):
                if not t.is_valid:
                    texts.append(None)
                    continue
                raw = t.as_buffer().to_pybytes()
                parts, at_byte = [], 0
                for start, end in _union([(a, b) for a, b, p in _judge(forest, raw) if p >= threshold]):
                    parts += [raw[at_byte:start], mark]
                    at_byte = end
                raw = b"".join([*parts, raw[at_byte:]])
                texts.append(raw.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(texts, pa.string()), *b.columns[at + 1 :]], names=b.schema.names)

    return run


def find_secrets(docs: DataFrame, forest: Forest | None = None, threshold: float = 0.5) -> DataFrame:
    """``doc_id, start, length, finding_sha256, score, secret`` per candidate of ``docs(doc_id, text)``.

    Places are in UTF-8 bytes; candidates may overlap.  Null and empty texts have no candidates.  Rows are
    independent of each other: repeated rows repeat their findings, a null id stays null.
    Other columns are ignored.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    out = "doc_id long, start long, length long, finding_sha256 string, score double, secret boolean"
    return src.mapInArrow(_find(forest or train(), threshold), out)


def redact_secrets(docs: DataFrame, forest: Forest | None = None, threshold: float = 0.5, mark: str = "<SECRET>") -> DataFrame:
    """All rows and columns of ``docs``; secrets in ``text`` are replaced by ``mark``."""
    src = docs.withColumn("text", F.col("text").cast("string"))
    return src.mapInArrow(_redact(forest or train(), threshold, mark.encode()), src.schema)
