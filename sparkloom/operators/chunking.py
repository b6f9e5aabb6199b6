"""Chunking strategies.  Each is a function of one text; Spark runs it in Arrow batches and explodes the chunks."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Config:
    """Sizes in tokens of the default counter: a run of word characters or one other visible character."""

    target: int = 412
    most: int = 512
    overlap: int = 50
    least: int = 50

    @staticmethod
    def of_size(size: int = 512) -> Config:
        return Config(max(1, size - 100), size, 50, 50)


@dataclass
class Chunk:
    content: str
    start: int = 0
    end: int = 0
    section: str | None = None
    kind: str = "text"


SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " ")
_TOKEN = re.compile(r"\w+|[^\w\s]")


def count(text: str) -> int:
    return len(_TOKEN.findall(text))


def token_windows(text: str, offset: int, size: int) -> list[tuple[int, str]]:
    marks = [m.span() for m in _TOKEN.finditer(text)]
    return [(offset + marks[k][0], text[marks[k][0] : marks[min(k + size, len(marks)) - 1][1]]) for k in range(0, len(marks), size)]


def pieces(text: str, config: Config, level: int = 0, offset: int = 0) -> list[tuple[int, str]]:
    """Parts of at most ``most`` tokens, cut at the coarsest separator that does."""
    if len(text) <= config.most or count(text) <= config.most:
        return [(offset, text)] if text.strip() else []
    if level == len(SEPARATORS):
        return token_windows(text, offset, config.target)
    out, at = [], 0
    for part in re.split(f"(?<={re.escape(SEPARATORS[level])})", text):
        out += pieces(part, config, level + 1, offset + at)
        at += len(part)
    return out


def merged(parts: list[tuple[int, str]], config: Config) -> list[Chunk]:
    """Neighbours joined up to the target; a chunk under the least size goes on growing."""
    out: list[Chunk] = []
    bodies: list[list[str]] = []
    held = 0  # no token spans the blank between two parts, so sizes add up
    for start, text in parts:
        body = text.strip()
        if not body:
            continue
        size = count(body)
        if out and (held + size <= config.target or held < config.least and held + size <= config.most):
            bodies[-1].append(body)
            held += size
            out[-1].end = start + len(text)
            continue
        out.append(Chunk("", start, start + len(text)))
        bodies.append([body])
        held = size
    for c, b in zip(out, bodies, strict=True):
        c.content = " ".join(b)
    return out


def overlapped(chunks: list[Chunk], overlap: int) -> list[Chunk]:
    """The last tokens of the chunk before, as it was, stand before each chunk."""
    if overlap <= 0 or not chunks:
        return chunks
    tails = [""] + [c.content[(m := [t.start() for t in _TOKEN.finditer(c.content)])[max(0, len(m) - overlap)] :] if c.content else "" for c in chunks[:-1]]
    return [Chunk(f"{t} {c.content}" if t else c.content, c.start, c.end, c.section, c.kind) for t, c in zip(tails, chunks, strict=True)]


def recursive(text: str, config: Config = Config()) -> list[Chunk]:
    return overlapped(merged(pieces(text, config), config), config.overlap)


_SENTENCE = re.compile(r"[^.!?]*[.!?]+[\"')\]]*\s*|[^.!?]+$")


def sentences(text: str) -> list[tuple[int, str]]:
    return [(m.start(), m.group()) for m in _SENTENCE.finditer(text) if m.group().strip()]


def trailing(parts: list[str], overlap: int) -> list[str]:
    """Whole sentences from the end that fit the overlap."""
    out: list[str] = []
    held = 0
    for s in reversed(parts):
        held += count(s)
        if held > overlap:
            break
        out.insert(0, s)
    return out


def semantic(text: str, config: Config = Config()) -> list[Chunk]:
    out: list[Chunk] = []
    held: list[str] = []
    fresh = total = 0
    start = end = 0

    def close() -> None:
        nonlocal held, fresh, total
        if fresh:
            out.append(Chunk(" ".join(held), start, end))
            held, fresh = trailing(held, config.overlap), 0
            total = sum(map(count, held))

    for at, raw in sentences(text):
        s = raw.strip()
        size = count(s)
        if size > config.most:
            close()
            held, fresh, total = [], 0, 0
            out += [Chunk(t, a, a + len(t)) for a, t in token_windows(raw, at, config.target)]
            continue
        if fresh and total + size > config.target:
            close()
        if not fresh:
            start = at
        held.append(s)
        total += size
        fresh += 1
        end = at + len(raw)
    close()
    return out


def heading_of(line: str) -> str | None:
    t = line.strip()
    if not t:
        return None
    words = t.split(None, 12)  # thirteen parts are too many for a heading
    if t.startswith("#") and t.lstrip("#").strip():
        return t.lstrip("#").strip()
    if 2 <= len(words) <= 12 and re.fullmatch(r"\d+(\.\d+)*\.*", words[0], re.ASCII) and t[-1] not in ".?!":
        return t.rstrip(":")
    if len(t) <= 100 and 2 <= len(words) <= 12 and not t.endswith(".") and len(t.encode()) <= 100:
        letters = [c for c in t if c.isalpha()]
        if len(letters) >= 4 and all(c.isupper() for c in letters):
            return t
    return t.rstrip(":") if t.endswith(":") and "://" not in t and 1 <= len(words) <= 10 else None


def sections(text: str) -> list[tuple[str | None, int, str]]:
    """(heading, start, body) with a body; the whole text where no line is a heading."""
    out: list[tuple[str | None, int, str]] = []
    name, begin, at, seen = None, 0, 0, False
    for line in text.splitlines(keepends=True):
        found = heading_of(line)
        if found is not None:
            seen = True
            out.append((name, begin, text[begin:at]))
            name, begin = found, at + len(line)
        at += len(line)
    out.append((name, begin, text[begin:]))
    kept = [s for s in out if s[2].strip()]
    return kept if seen else ([(None, 0, text)] if text.strip() else [])


def hierarchical(text: str, config: Config = Config()) -> list[Chunk]:
    return [Chunk(c.content, c.start + at, c.end + at, name) for name, at, body in sections(text) for c in recursive(body, config)]


_ASKS = re.compile(r"^\s*(?:Q|Question)\s*[:.]\s*(.+)$", re.IGNORECASE)
_ANSWERS = re.compile(r"^\s*(?:A|Answer)\s*[:.]\s*(.*)$", re.IGNORECASE)


def _explicit(text: str) -> list[tuple[str, str]]:
    out: list[list] = []
    answering = False
    for line in text.splitlines():
        if m := _ASKS.match(line):
            out.append([m.group(1).strip(), []])
            answering = False
        elif out and (m := _ANSWERS.match(line)):
            out[-1][1].append(m.group(1).strip())
            answering = True
        elif out and answering and line.strip():
            out[-1][1].append(line.strip())
    return [(q, "\n".join(a)) for q, a in out if a]


def _headed(text: str) -> list[tuple[str, str]]:
    found = [(name, body.strip()) for name, _, body in sections(text) if name and name.endswith("?")]
    return [x for x in found if x[1]]


def _implied(text: str) -> list[tuple[str, str]]:
    parts = [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]
    return [(a, b) for a, b in zip(parts, parts[1:], strict=False) if a.endswith("?") and not b.endswith("?")]


def qa_pairs(text: str) -> list[tuple[str, str]]:
    """Marked questions, else questions as headings, else question paragraphs with an answer after them."""
    return _explicit(text) or _headed(text) or _implied(text)


#: Bytes from which a pair's answer is split.
PAIR_BYTES = 1600


def qa(text: str, config: Config = Config()) -> list[Chunk]:
    pairs = qa_pairs(text)
    if len(pairs) < 3:
        return semantic(text, config)
    out = []
    for q, a in pairs:
        whole = f"{q}\n{a}"
        if len(whole.encode()) <= PAIR_BYTES:
            out.append(Chunk(whole, 0, len(whole), kind="qa"))
            continue
        for k, c in enumerate(recursive(a, config)):
            out.append(Chunk(f"{q}{' (continued)' if k else ''}\n{c.content}", c.start, c.end, kind="qa"))
    return out


_RULE = re.compile(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")


def _cells(line: str) -> list[str]:
    return [c.strip() for c in line.strip().strip("|").split("|")]


def markdown_table(text: str) -> tuple[list[str], list[list[str]]] | None:
    """Header and rows of the first run of three or more bar lines with a rule; ragged rows go."""
    run: list[str] = []
    for line in [*text.splitlines(), ""]:
        if "|" in line:
            run.append(line)
            continue
        if len(run) >= 3 and _RULE.match(run[1]):
            head = _cells(run[0])
            return head, [r for r in map(_cells, run[2:]) if len(r) == len(head)]
        run = []
    return None


def csv_table(text: str) -> tuple[list[str], list[list[str]]] | None:
    """All lines of one width of two or more columns, two lines at least."""
    rows: list[list[str]] = []
    for r in csv.reader(io.StringIO(text.strip())):
        if not r:
            continue
        if len(r) < 2 or rows and len(r) != len(rows[0]):
            return None
        rows.append(r)
    if len(rows) < 2:
        return None
    return [c.strip() for c in rows[0]], [[c.strip() for c in r] for r in rows[1:]]


def tabular(text: str, config: Config = Config()) -> list[Chunk]:
    """Rows packed to the target under a repeated header; texts without a table by sentences."""
    table = markdown_table(text) or csv_table(text)
    if table is None:
        return semantic(text, config)
    head = " | ".join(table[0])
    out: list[Chunk] = []
    held: list[str] = []
    first = 0

    def close(end: int) -> None:
        if held:
            out.append(Chunk("\n".join([head, *held]), first, end, kind="table"))

    for k, row in enumerate(table[1]):
        line = " | ".join(row)
        if held and sum(max(1, len(x.encode()) // 4) for x in [head, *held, line]) > config.target:
            close(k)
            held, first = [], k
        held.append(line)
    close(len(table[1]))
    return out


def zones(text: str) -> list[tuple[str, str]]:
    """Runs of fenced code, bar lines and prose; prose with two pairs or more is qa."""
    out: list[list] = []
    fenced = False
    for line in text.splitlines():
        fence = line.strip().startswith("```")
        kind = "code" if fence or fenced else "table" if "|" in line else "prose"
        fenced = fenced != fence
        if out and out[-1][0] == kind:
            out[-1][1].append(line)
        else:
            out.append([kind, [line]])
    named = [(k, "\n".join(lines)) for k, lines in out]
    return [("qa" if k == "prose" and len(qa_pairs(t)) >= 2 else k, t) for k, t in named if t.strip()]


def mixed(text: str, config: Config = Config()) -> list[Chunk]:
    out = []
    for kind, body in zones(text):
        if kind == "table":
            found = tabular(body, config)
        elif kind == "code":
            found = recursive(body, Config(max(1, config.target // 2), config.most, 0, config.least))
        elif kind == "qa":
            found = qa(body, config)
        else:
            sizes = [len(s.strip().encode()) for _, s in sentences(body)]
            found = semantic(body, config) if sizes and sum(sizes) / len(sizes) >= 80 else recursive(body, config)
        out += [Chunk(c.content, c.start, c.end, c.section, kind) for c in found]
    return out


STRATEGIES: dict[str, Callable[[str, Config], list[Chunk]]] = {
    "recursive": recursive,
    "semantic": semantic,
    "hierarchical": hierarchical,
    "qa": qa,
    "tabular": tabular,
    "mixed": mixed,
}
# Other names of the strategies.
ALIASES = {"sentence": "semantic", "section": "hierarchical", "faq": "qa", "table": "tabular", "csv": "tabular", "mixed_content": "mixed", "token": "recursive"}


def strategy_name(raw: str | None) -> str:
    name = (raw or "").strip().lower()
    name = ALIASES.get(name, name)
    return name if name in STRATEGIES else "auto"


def select_strategy() -> Column:
    """The decision list over n_bytes, headings, mean_sentence and prose of plain texts."""
    n, h = F.col("n_bytes"), F.col("headings")
    density = F.when(n > 0, h / (n / 1000.0)).otherwise(0.0)
    return (
        F.when(n < 1500, "recursive")
        .when((density >= 3) | (h >= 3) & (density >= 1), "hierarchical")
        .when((F.col("mean_sentence") >= 120) & (F.col("prose") >= 0.6), "semantic")
        .when((n > 5000) & (F.col("prose") >= 0.7) & (h <= 1), "semantic")
        .otherwise("recursive")
    )


def select_for(profile: dict) -> str:
    """The whole list of rules for one parsed document's profile."""
    p = {"extension": "", "blocks": 0, "tables": 0, "code": 0, "pairs": 0, "variance": 0.0, "structured": 0, "headings": 0, "density": 0.0, "n_bytes": 0, "mean_sentence": 0.0, "prose": 0.0} | profile
    of_blocks = lambda x: x / p["blocks"] if p["blocks"] else 0.0
    markdown = p["extension"] in ("md", "markdown")
    rules = (
        (p["extension"] == "csv", "tabular"),
        (of_blocks(p["tables"]) > 0.2, "tabular"),
        (p["pairs"] >= 3, "qa"),
        (p["variance"] >= 0.3 and p["blocks"] >= 10 and p["tables"] > 0, "mixed"),
        (markdown and max(p["headings"], p["structured"]) >= 2, "hierarchical"),
        (markdown, "recursive"),
        (p["structured"] >= 3 and of_blocks(p["structured"]) >= 0.05, "hierarchical"),
        (of_blocks(p["code"]) > 0.3, "recursive"),
        (p["n_bytes"] < 1500, "recursive"),
        (p["density"] >= 3 or p["headings"] >= 3 and p["density"] >= 1, "hierarchical"),
        (p["mean_sentence"] >= 120 and p["prose"] >= 0.6, "semantic"),
        (p["n_bytes"] > 5000 and p["prose"] >= 0.7 and p["headings"] <= 1, "semantic"),
        (p["extension"] in ("html", "htm") and p["headings"] >= 2, "hierarchical"),
    )
    return next((name for holds, name in rules if holds), "recursive")


_SCHEMA = pa.schema([("chunk_index", pa.int32()), ("content", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("tokens", pa.int32()), ("section", pa.string()), ("kind", pa.string())])


def profile(text: str, extension: str = "", kinds: list[str] = (), tables: int = 0) -> dict:
    """What the strategy rules look at: the text, its file's extension and the kinds of its parsed blocks."""
    heads = sum(heading_of(x) is not None for x in text.splitlines())
    size = len(text.encode())
    lengths = [len(s.strip().encode()) for _, s in sentences(text) if len(s.strip()) > 3]
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    blocks = len(kinds) + tables
    texts = any(k not in ("code", "image") for k in kinds)
    return {
        "extension": extension.lower(),
        "blocks": blocks,
        "tables": tables,
        "code": sum(k == "code" for k in kinds),
        "structured": sum(k == "heading" for k in kinds),
        "variance": (texts + (tables > 0) + ("code" in kinds) + ("image" in kinds)) / 4 if blocks else 0.0,
        "pairs": len(qa_pairs(text)),
        "headings": heads,
        "density": heads / (size / 1000) if size else 0,
        "n_bytes": size,
        "mean_sentence": sum(lengths) / len(lengths) if lengths else 0.0,
        "prose": sum(x[-1] in ".?!\")" for x in lines) / len(lines) if lines else 0.0,
    }


def chunk(
    docs: DataFrame,
    strategy: str | None = None,
    config: Config = Config(),
    id_col: str = "doc_id",
    text_col: str = "text",
    extension: Column | None = None,
    kinds: Column | None = None,
    tables: Column | None = None,
) -> DataFrame:
    """(doc_id, chunk_index, content, start, stop, tokens, section, kind); ``auto`` picks a strategy by profile.

    ``extension`` of the file, ``kinds`` of its parsed blocks and the number of
    its ``tables`` take part in that choice where they are known.  Texts never
    leave the task that reads them; null texts have no chunks.
    """
    name = strategy_name(strategy)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                owners, rows = [], []
                for k, (text, ext, blocks, n) in enumerate(zip(*[part.column(i).to_pylist() for i in range(1, 5)], strict=True)):
                    how = STRATEGIES[select_for(profile(text or "", ext or "", blocks or [], n or 0)) if name == "auto" else name]
                    for i, c in enumerate(how(text or "", config)):
                        owners.append(k)
                        rows.append((i, c.content, c.start, c.end, count(c.content), c.section, c.kind))
                cols = zip(*rows, strict=True) if rows else [[] for _ in _SCHEMA]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(owners, pa.int32())), *[pa.array(c, t) for c, t in zip(cols, _SCHEMA.types, strict=True)]], names=["doc_id", *_SCHEMA.names]
                )

    known = [F.lit(None).cast(t) if c is None else c.cast(t) for c, t in ((extension, "string"), (kinds, "array<string>"), (tables, "int"))]
    part = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), known[0].alias("extension"), known[1].alias("kinds"), known[2].alias("tables"))
    kind = part.schema["doc_id"].dataType.simpleString()
    return part.mapInArrow(work, f"doc_id {kind}, chunk_index int, content string, start int, stop int, tokens int, section string, kind string")
