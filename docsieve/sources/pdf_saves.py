"""The tables of all saves of a PDF, and its object graph, as rows; each object is parsed once."""

from __future__ import annotations

from collections.abc import Iterable

from .pdf import Document, Lexer, PdfError, Ref, Stream

MAX_LEVELS = 60


class Irregular(PdfError):
    """The saves don't build on each other plainly; each has to be opened by itself."""


class _Tables(Document):
    """A document whose tables are read on demand, one save after the other."""

    def __init__(self, raw: bytes):
        self.raw, self.where, self.cache, self.packed, self.trailer = raw, {}, {}, {}, {}

    def section(self, at: int) -> tuple[dict, dict]:
        """(places, head) of the table at an offset."""
        self.where = {}
        lex = Lexer(self.raw, at)
        lex.skip()
        if self.raw.startswith(b"xref", lex.at):
            lex.at += 4
            head = self._table(lex)
        else:
            head = self._xref_stream(lex)
        return self.where, head


def read_saves(raw: bytes, ends: list[int]) -> dict:
    """Rows of operators.saves for the saves that end at these offsets, in order: saves (save, root, creation_date, mod_date, locked),
    changes (save, object, alive), nodes (save, object, leaves, kids). Saves are numbered from 0. Irregular where tables are broken."""
    doc = _Tables(raw)
    sections: dict[int, tuple[dict, dict]] = {}
    state: dict[int, tuple] = {}
    version: dict[int, int] = {}  # the save that an object's place is from
    out: dict = {"saves": [], "changes": [], "nodes": []}
    known: set[int] = set()
    done: set[tuple[int, int]] = set()
    before: list[int] = []
    for save, end in enumerate(ends):
        chain = _chain(doc, sections, raw.rfind(b"startxref", 0, end), end)
        fresh = chain[:len(chain) - len(before)]
        if chain[len(fresh):] != before:
            raise Irregular("a save doesn't build on the one before")
        before = chain
        delta: dict[int, tuple] = {}
        for at in fresh:
            for num, place in sections[at][0].items():
                delta.setdefault(num, place)
        head: dict = {}
        for at in chain:
            for key, value in sections[at][1].items():
                head.setdefault(key, value)
        changed = {n for n, p in delta.items() if state.get(n) != p}
        streams = {p[1] for n, p in state.items() if p[0] == "in"} if changed else set()
        if streams & changed & set(state):
            raise Irregular("an object stream was replaced")
        state.update(delta)
        version.update(dict.fromkeys(delta, save))
        doc.where = state
        for n in changed:
            doc.cache.pop(n, None)
        out["changes"] += [(save, n, p[0] != "free") for n, p in delta.items()]
        root = head.get("Root")
        if not isinstance(root, Ref):
            raise Irregular("there is no catalog")
        _nodes(doc, root.num, changed, save, version, known, done, out["nodes"])
        doc.trailer = head
        created, modified = doc.info()
        out["saves"].append((save, root.num, created, modified, head.get("Encrypt") is not None))
    _check_depth(out)
    return out


def _chain(doc: _Tables, sections: dict, mark: int, end: int) -> list[int]:
    """Offsets of the tables of a save, the newest first."""
    if mark < 0:
        raise Irregular("there is no startxref")
    todo, chain = [Lexer(doc.raw, mark + 9).value()], []
    while todo:
        at = todo.pop(0)
        if not isinstance(at, int) or not 0 <= at < end:
            raise Irregular("a table lies outside the save")
        if at in chain:
            continue
        if at not in sections:
            sections[at] = doc.section(at)
        chain.append(at)
        head = sections[at][1]
        todo += [head[k] for k in ("XRefStm", "Prev") if isinstance(head.get(k), int)]
    return chain


def _nodes(doc: Document, root: int, changed: set[int], save: int, version: dict, known: set[int], done: set, out: list) -> None:
    """Page tree objects that this save changed, or that it is the first to lead to; those of former saves are known."""
    todo = [root, *(n for n in changed if n in known)]
    while todo:
        num = todo.pop()
        key = (num, version.get(num, -1))
        if key in done:
            continue
        done.add(key)
        known.add(num)
        value = doc.object(num)
        kids: list[int] = []
        if num == root:
            if not isinstance(value, dict) or "Pages" not in value:
                raise Irregular("there is no page tree")
            leaves = _below(value["Pages"], kids, 0)
        elif isinstance(value, list):  # the list of kids as an object of its own
            leaves = sum(_below(kid, kids, 0) for kid in value)
        else:
            leaves = _below(value, kids, 0)
        out.append((max(key[1], 0), num, leaves, kids))
        todo += kids


def _below(node, kids: list[int], depth: int) -> int:
    """Pages in a node that stands by itself; references are added to kids."""
    if isinstance(node, Ref):
        kids.append(node.num)
        return 0
    if not isinstance(node, dict):
        return 0
    if depth > MAX_LEVELS:
        raise Irregular("the page tree is nested too deeply")
    inner = node.get("Kids")
    if node.get("Type") == "Pages" or isinstance(inner, (list, Ref)) and node.get("Type") != "Page":
        if isinstance(inner, Ref):
            kids.append(inner.num)
            return 0
        return sum(_below(kid, kids, depth + 1) for kid in inner or [])
    return 1


def _check_depth(out: dict) -> None:
    """Trees deeper than is read one save at a time are left to that way."""
    below: dict[int, set[int]] = {}
    for _, num, _, kids in out["nodes"]:
        below.setdefault(num, set()).update(kids)
    front, seen = {root for _, root, *_ in out["saves"]}, set()
    for _ in range(MAX_LEVELS):
        seen |= front
        front = {k for n in front for k in below.get(n, ())} - seen
        if not front:
            return
    raise Irregular("the page tree is nested too deeply")


def _refs(value) -> Iterable[int]:
    if isinstance(value, Ref):
        yield value.num
    elif isinstance(value, list):
        for v in value:
            yield from _refs(v)
    elif isinstance(value, dict):
        for v in value.values():
            yield from _refs(v)
    elif isinstance(value, Stream):
        yield from _refs(value.head)


def object_links(doc: Document) -> tuple[list[int], list[tuple[int | None, int]]]:
    """(objects, links) of the graph: a link for each different reference of an object; those of the trailer have no source."""
    objects = [n for n, p in doc.where.items() if p[0] != "free"]
    links: list[tuple[int | None, int]] = [(None, r) for k in ("Root", "Info") for r in _refs(doc.trailer.get(k))]
    for n in objects:
        try:
            links += [(n, r) for r in dict.fromkeys(_refs(doc.object(n)))]
        except (PdfError, EOFError, ValueError, TypeError, KeyError, IndexError):
            continue  # an object that can't be read leads nowhere
    return objects, links
