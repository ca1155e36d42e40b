"""Chunkers. Packing depends on order, so each document is cut by one Python function inside an Arrow batch."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import pieces

_SPACE = "".join(map(chr, range(33)))
_ENDS = "。！？；.!?;\n"
_SENTENCE = re.compile(f"[^{_ENDS}]*[{_ENDS}]|[^{_ENDS}]+$")

#: A section: title, content, level, position.
Section = tuple[str | None, str, int, int]


def split_sentences(text: str) -> list[str]:
    return [s for s in (p.strip(_SPACE) for p in _SENTENCE.findall(text)) if s]


def split_paragraphs(text: str) -> list[str]:
    return [p for p in (x.strip(_SPACE) for x in re.split(r"\n\n+", text)) if p]


def tail_after_sentence(chunk: str, n: int, ends: str = "。！？.!?") -> str:
    """The overlap of a chunk: of its last n characters what follows the last sentence end in their second half, else all of them.

    A chunk that ends with a sentence end has no overlap.
    """
    chunk = chunk.strip(_SPACE)
    last = chunk[-n:] if n > 0 else ""
    at = max((last.rfind(e) for e in ends), default=-1)
    return last[at + 1 :].strip(_SPACE) if at > n // 2 else last.strip(_SPACE)


def raw_tail(chunk: str, n: int) -> str:
    return chunk[-n:] if n > 0 else ""


def pack(pieces: list[str], most: int, overlap: Callable[[str], str] = lambda c: "", joint: str = "") -> list[str]:
    """Greedy packing: a piece that does not fit closes the chunk and begins the next one behind the overlap.

    Pieces are never cut, so a long one makes a long chunk. joint follows each piece.
    """
    out, cur = [], ""
    for piece in pieces:
        if cur and len(cur) + len(piece) > most:
            done = cur.strip(_SPACE)
            out.append(done)
            cur = overlap(done)
        cur += piece + joint
    if cur.strip(_SPACE):
        out.append(cur.strip(_SPACE))
    return out


def _chunk(name: str, kind: str, i: int, content: str, **more) -> dict:
    return {"chunk_id": f"{name}_{kind}_{i}", "content": content, "chunk_index": i, "total_chunks": None, "title": None, "level": kind, "parent_id": None} | more


def semantic(text: str, sections: list[Section], name: str, most: int = 500, overlap: int = 50, keep_sentence_end_rule: bool = True) -> list[dict]:
    """Sections as they are if short, else packed sentences with overlap; without sections the whole text packed.

    The index runs through the document, total_chunks counts a section. With keep_sentence_end_rule a chunk that ends a
    sentence gives no overlap; without it the last characters always do.
    """
    cut = (lambda c: tail_after_sentence(c, overlap)) if keep_sentence_end_rule else (lambda c: raw_tail(c, overlap))
    out: list[dict] = []
    for title, content, _, _ in sections or [(None, text, 0, 0)]:
        if not content.strip(_SPACE):
            continue
        parts = [content] if sections and len(content) <= most else pack(split_sentences(content), most, cut)
        out += [_chunk(name, "chunk", len(out) + i, p, total_chunks=len(parts), title=title) for i, p in enumerate(parts)]
    return out


def parent_child(text: str, name: str, parent: int = 500, child: int = 125, overlap: int = 25) -> list[dict]:
    """Parents of packed paragraphs and, in each, children of packed sentences; sizes double for the limit. Children name their parent."""
    parents = [text.strip(_SPACE)] if len(text) <= 2 * parent else pack(split_paragraphs(text), 2 * parent, joint="\n\n")
    parents = [p for p in parents if p]
    rows = [_chunk(name, "parent", i, p, total_chunks=len(parents)) for i, p in enumerate(parents)]
    children = []
    for i, p in enumerate(parents):
        parts = [p] if len(p) <= 2 * child else pack(split_sentences(p), 2 * child, lambda c: raw_tail(c, overlap))
        children += [_chunk(name, "child", len(children) + j, c, parent_id=f"{name}_parent_{i}") for j, c in enumerate(parts)]
    for c in children:
        c["total_chunks"] = len(children)
    return rows + children


def multi(text: str, sections: list[Section], name: str, section: int = 1000, paragraph: int = 400, sentence: int = 150) -> list[dict]:
    """Three levels side by side: packed paragraphs, paragraphs (packed sentences of a long one), packed sentences."""
    levels: dict[str, list[str]] = {"section": [], "paragraph": [], "sentence": []}
    for _, content, _, _ in sections or [(None, text, 0, 0)]:
        paras = split_paragraphs(content)
        levels["section"] += pack(paras, section, joint="\n\n")
        for p in paras:
            levels["paragraph"] += [p] if len(p) <= paragraph else pack(split_sentences(p), paragraph)
        levels["sentence"] += pack(split_sentences(content), sentence)
    return [_chunk(name, kind, i, c, total_chunks=len(parts)) for kind, parts in levels.items() for i, c in enumerate(parts)]


def legacy(text: str, name: str, most: int = 500, overlap: int = 50) -> list[dict]:
    """Packed paragraphs whose overlap knows three sentence ends only."""
    parts = pack(split_paragraphs(text), most, lambda c: tail_after_sentence(c, overlap, "。？！"), "\n\n")
    return [_chunk(name, "chunk", i, c, total_chunks=len(parts)) for i, c in enumerate(parts)]


def segments(text: str, n: int) -> list[str]:
    """Windows of n characters, each cut behind the last full stop or line break in its second half (searched from the end on, so one may have n + 1)."""
    out, at = [], 0
    while at < len(text):
        end = min(at + n, len(text))
        if end < len(text):
            stop = max(text.rfind("。", 0, end + 1), text.rfind("\n", 0, end + 1))
            if stop > at + n // 2:
                end = stop + 1
        out.append(text[at:end])
        at = end
    return out


def summary_index(text: str, sections: list[Section], name: str, most: int = 500, shown: int = 100, summarise: Callable[[str], str | None] | None = None) -> list[dict]:
    """A summary chunk for each packed chunk: by the model given, else its first characters. The index runs through all sections."""
    out = []
    for _, content, _, _ in sections or [(None, text, 0, 0)]:
        for c in [content] if len(content) <= most else pack(split_paragraphs(content), most, joint="\n\n"):
            if not c.strip(_SPACE):
                continue
            i = len(out)
            summary = (summarise(c) if summarise else None) or (c[:shown] + "..." if len(c) > shown else c)
            out.append(_chunk(name, "chunk", i, summary, parent_id=f"{name}_chunk_{i}", title=c) | {"chunk_id": f"{name}_chunk_{i}_summary", "level": "summary"})
    return out


def contextual(text: str, sections: list[Section], name: str, size: int = 5, contexts: Callable[[str, list[str]], list[str]] | None = None) -> list[dict]:
    """A chunk a section, behind a context that a model gives for `size` of them at a time; a missing answer counts as empty."""
    own = [(t, c) for t, c, _, _ in sections or [(None, text, 0, 0)] if c.strip(_SPACE)]
    size, said = max(1, size), []
    for i in range(0, len(own), size):
        part = [c for _, c in own[i : i + size]]
        got = list(contexts(text, part)) if contexts else []
        said += (got + [""] * len(part))[: len(part)]
    return [_chunk(name, "chunk", i, f"{s}\n{c}", total_chunks=len(own), title=t) | {"chunk_id": f"{name}_chunk_{i}_ctx"} for i, ((t, c), s) in enumerate(zip(own, said, strict=True))]


def propositions(text: str | None, name: str, most_input: int = 2000, most: int = 300, model: Callable[[str], str | None] | None = None) -> list[dict]:
    """Statements that a model lists for each segment as a JSON array; the whole text where there is no model or it fails. None for no text."""
    import json

    if text is None or not text.strip(_SPACE):
        return []
    found: list[str] = []
    for part in [text] if len(text) <= most_input else segments(text, most_input):
        reply = model(part) if model else None
        start, end = (reply or "").find("["), (reply or "").rfind("]")
        try:
            items = json.loads(reply[start : end + 1]) if reply and 0 <= start < end else None
        except ValueError:
            items = None
        found += [part] if items is None else [s.strip(_SPACE) for s in items if isinstance(s, str) and s.strip(_SPACE) and len(s.strip(_SPACE)) <= most]
    return [_chunk(name, "prop", i, p, total_chunks=len(found)) for i, p in enumerate(found)]


SCHEMA = "doc_id long, chunk_id string, content string, chunk_index long, total_chunks long, title string, level string, parent_id string"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def chunked(docs: DataFrame, chunker: Callable[[str, list[Section], str], list[dict]], id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None) -> DataFrame:
    """Rows of SCHEMA: each document through chunker(text, sections, name). Null texts have no chunks."""
    cols = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")]
    if sections_col:
        cols.append(F.col(sections_col).alias("sections"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (piece for whole in batches for piece in pieces(whole, "text")):
            rows = []
            for r in pdf.itertuples(index=False):
                own = [(s["title"], s["content"], s["level"], s["position"]) for s in r.sections] if sections_col and r.sections is not None else []
                if isinstance(r.text, str):
                    rows += [c | {"doc_id": r.doc_id} for c in chunker(r.text, own, str(r.doc_id))]
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return docs.select(*cols).mapInPandas(run, SCHEMA)


def by_question(chunks: DataFrame, kind: str) -> DataFrame:
    """Chunks of the level that suits a kind of question."""
    level = {"CONCEPT": "section", "DETAIL": "sentence"}.get(kind, "paragraph")
    return chunks.where(F.col("level") == level)
