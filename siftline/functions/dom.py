"""Pages as numbered nodes: the one pass in which Python reads markup, in Arrow batches (FN-64, FN-65, FN-69, SRC-07)."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa

from .html import objects

# Tags without content, tags whose content isn't text, and tags that hold a thing of its own.
EMPTY = {"area", "base", "basefont", "bgsound", "br", "col", "command", "embed", "frame", "hr", "image", "img", "input", "isindex", "keygen", "link", "menuitem", "meta", "nextid", "param", "source", "spacer", "track", "wbr"}
SILENT = {"script", "style", "template"}
BOXES = {"article", "li", "section", "div"}
#: How many ancestors a node names itself.
NEAR = 6

#: n: place in document order; last: the last node inside; up: the nearest ancestors, nearest first; box: the nearest of
#: BOXES around; before, after: neighbouring sibling elements; t0, t1: from where to where the node's text stands in the page's.
NODE = "struct<n:int,last:int,up:array<int>,box:int,before:int,after:int,tag:string,attrs:map<string,string>,t0:int,t1:int>"
THING = "struct<email:string,types:array<string>,name:string,evidence:string,purpose:string>"
PAGE = f"text string, nodes array<{NODE}>, things array<{THING}>"


class Numbering(HTMLParser):
    """Numbers elements and texts in document order. An end tag closes all that is open inside its element; others are ignored."""

    def __init__(self):
        super().__init__()
        self.nodes, self.stack, self.said, self.length, self.scripts, self.held = [], [], [], 0, [], []
        self.open: dict[str, int] = {}
        self.youngest: dict[int, int] = {}  # the last child element of each open node

    def node(self, tag: str, attrs: dict) -> dict:
        above = self.stack[-1] if self.stack else None
        box = -1 if above is None else above["n"] if above["tag"] in BOXES else above["box"]
        out = {"n": len(self.nodes), "last": len(self.nodes), "up": [] if above is None else [above["n"], *above["up"][: NEAR - 1]], "box": box, "before": -1, "after": -1, "tag": tag, "attrs": list(attrs.items()), "t0": -1, "t1": self.length}
        self.nodes.append(out)
        return out

    def flush(self) -> None:
        words, self.held = " ".join("".join(self.held).split()), []
        if not words:
            return
        if self.stack and self.stack[-1]["tag"] in SILENT:
            return
        out = self.node("#text", {})
        out["t0"] = self.length + 1 if self.length else 0
        self.length = out["t1"] = out["t0"] + len(words)
        self.said.append(words)

    def close_one(self) -> None:
        done = self.stack.pop()
        self.open[done["tag"]] -= 1
        done["last"] = len(self.nodes) - 1

    def handle_starttag(self, tag, attributes):
        self.flush()
        out = self.node(tag, {k: v or "" for k, v in attributes})
        above = out["up"][0] if out["up"] else -1
        if above in self.youngest:
            out["before"] = self.youngest[above]
            self.nodes[out["before"]]["after"] = out["n"]
        self.youngest[above] = out["n"]
        if tag not in EMPTY:
            self.stack.append(out)
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attributes):
        self.handle_starttag(tag, attributes)
        if tag not in EMPTY:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.flush()
        while self.open.get(tag):
            found = self.stack[-1]["tag"] == tag
            self.close_one()
            if found:
                break

    def handle_data(self, data):
        self.held.append(data)
        if self.stack and self.stack[-1]["tag"] == "script" and dict(self.stack[-1]["attrs"]).get("type", "").lower() == "application/ld+json":
            self.scripts.append((self.stack[-1]["n"], data))

    def handle_comment(self, data):
        self.flush()

    def close(self):
        super().close()
        self.flush()
        while self.stack:
            self.close_one()
        start = self.length  # a node's text begins with the first text inside it
        for x in reversed(self.nodes):
            if x["tag"] == "#text":
                start = x["t0"]
            else:
                x["t0"] = start
        end = 0
        ends = []
        for x in self.nodes:
            end = x["t1"] if x["tag"] == "#text" else end
            ends.append(end)
        for x in self.nodes:
            if x["tag"] != "#text":
                x["t1"] = ends[x["last"]]
                if x["t1"] <= x["t0"]:  # no text inside
                    x["t0"] = x["t1"]


def stated(raw: str) -> list[dict]:
    """What a block of structured data says of addresses; one that can't be read says nothing."""
    try:
        found = list(objects(json.loads(raw)))
    except (ValueError, RecursionError):
        return []
    out = []
    for x in found:
        if x.get("email"):
            kinds = x.get("@type", "")
            purpose = str(x.get("contactType") or x.get("description") or "")[:500]
            out.append({"email": str(x["email"]).removeprefix("mailto:"), "types": [str(k) for k in (kinds if isinstance(kinds, list) else [kinds])], "name": x["name"] if isinstance(x.get("name"), str) else None, "evidence": json.dumps(x, ensure_ascii=False)[:1200], "purpose": purpose})
    return out


def numbered(markup: str | None) -> dict:
    page = Numbering()
    page.feed(markup or "")
    page.close()
    blocks: dict[int, str] = {}
    for n, data in page.scripts:
        blocks[n] = blocks.get(n, "") + data
    return {"text": " ".join(page.said), "nodes": page.nodes, "things": [x for raw in blocks.values() for x in stated(raw)]}


def reader(schema: pa.Schema):
    """Record batches whose last column is markup, with text, nodes and things in its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(a, 64) for a in range(0, whole.num_rows, 64)):
                read = [numbered(markup) for markup in batch.columns[-1].to_pylist()]
                made = [pa.array([r[name] for r in read], schema.field(name).type) for name in ("text", "nodes", "things")]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], schema=schema)

    return run
