"""Documents as plain objects: a fluent builder, lossless JSON, traversal, and the rows that operators take."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Block:
    """kind is one of operators.documents.KINDS; quotes hold blocks of their own."""

    kind: str
    text: str = ""
    level: int = 0
    ordered: bool = False
    language: str | None = None
    display: bool = True
    attribution: str | None = None
    rows: list[list[str]] = field(default_factory=list)
    items: list[str] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)

    def inlines(self) -> list[str]:
        """Its texts: headings, paragraphs, items, cells, and those of a quote's blocks; none of formulas, figures, code and rules."""
        if self.kind == "quote":
            return [x for b in self.blocks for x in b.inlines()]
        if self.kind == "table":
            return [c for r in self.rows for c in r]
        if self.kind == "list":
            return list(self.items)
        return [self.text] if self.kind in ("heading", "paragraph") else []

    def lines(self) -> str:
        """Its text as a row has it: a line an item, a row of cells with tabs between, or a block of a quote."""
        one = lambda x: " ".join(x.split())
        if self.kind == "list":
            return "\n".join(map(one, self.items))
        if self.kind == "table":
            return "\n".join("\t".join(map(one, r)) for r in self.rows)
        if self.kind == "quote":
            said = [x for b in self.blocks for x in (b.lines() if b.kind != "formula" else f"$${b.text}$$").split("\n")]
            return "\n".join([*said, *([f"— {self.attribution}"] if self.attribution else [])])
        return self.text

    def collected(self) -> str:
        """Its text, a line a heading, paragraph, formula, item or code block; tables and figures have none."""
        if self.kind == "horizontal_rule":
            return "---\n"
        if self.kind == "quote":
            return "".join(b.collected() for b in self.blocks)
        if self.kind == "list":
            return "".join(x + "\n" for x in self.items)
        return "" if self.kind in ("table", "figure") else self.text + "\n"


@dataclass
class Page:
    width: float = 0.0
    height: float = 0.0
    number: int | None = None
    blocks: list[Block] = field(default_factory=list)


class Visitor:
    """Called for a document, its pages, its blocks (those of quotes too) and their texts, in order; override what is wanted."""

    def document(self, document: Document) -> None: ...

    def page(self, page: Page) -> None: ...

    def block(self, block: Block) -> None: ...

    def inline(self, text: str) -> None: ...


@dataclass
class Document:
    metadata: dict = field(default_factory=dict)
    pages: list[Page] = field(default_factory=list)

    def block_count(self) -> int:
        return sum(len(p.blocks) for p in self.pages)

    def accept(self, visitor: Visitor) -> Visitor:
        def down(block: Block) -> None:
            visitor.block(block)
            for b in block.blocks:
                down(b)
            for x in [] if block.kind == "quote" else block.inlines():
                visitor.inline(x)

        visitor.document(self)
        for p in self.pages:
            visitor.page(p)
            for b in p.blocks:
                down(b)
        return visitor

    def all_blocks(self) -> list[Block]:
        return [b for p in self.pages for b in p.blocks]

    def get_block(self, page: int, place: int) -> Block | None:
        return self.pages[page].blocks[place] if 0 <= page < len(self.pages) and 0 <= place < len(self.pages[page].blocks) else None

    def text(self) -> str:
        return "".join(b.collected() for b in self.all_blocks())

    def to_json(self, pretty: bool = True) -> str:
        return json.dumps(self, default=lambda o: o.__dict__, ensure_ascii=False, indent=2 if pretty else None)

    @staticmethod
    def from_json(text: str) -> Document:
        def block(x: dict) -> Block:
            return Block(**(x | {"blocks": [block(b) for b in x.get("blocks", [])]}))

        data = json.loads(text)
        return Document(data.get("metadata", {}), [Page(p.get("width", 0.0), p.get("height", 0.0), p.get("number"), [block(b) for b in p.get("blocks", [])]) for p in data.get("pages", [])])

    def rows(self) -> list[tuple]:
        """(page_idx, ord, kind, level, text, language, ordered) of its top-level blocks, as operators take them."""
        return [(i, j, b.kind, b.level, b.lines(), b.language, b.ordered) for i, p in enumerate(self.pages) for j, b in enumerate(p.blocks)]


def frame(spark: SparkSession, documents: dict[int, Document]) -> DataFrame:
    """The block table of documents by id."""
    return spark.createDataFrame([(k, *r) for k, d in documents.items() for r in d.rows()], "doc_id long, page_idx int, ord int, kind string, level int, text string, language string, ordered boolean")


class Builder:
    """Builds a document: page(), then its blocks, then build()."""

    def __init__(self, **metadata):
        self.document = Document(dict(metadata))

    def page(self, width: float = 0.0, height: float = 0.0) -> Builder:
        self.document.pages.append(Page(width, height, len(self.document.pages) + 1))
        return self

    def _add(self, block: Block) -> Builder:
        if not self.document.pages:
            self.page()
        self.document.pages[-1].blocks.append(block)
        return self

    def heading(self, level: int, text: str) -> Builder:
        return self._add(Block("heading", text, min(max(level, 1), 6)))

    def paragraph(self, text: str) -> Builder:
        return self._add(Block("paragraph", text))

    def formula(self, latex: str) -> Builder:
        """A paragraph that holds the formula."""
        return self._add(Block("paragraph", f"$${latex}$$"))

    def display_formula(self, latex: str) -> Builder:
        return self._add(Block("formula", latex))

    def code(self, code: str, language: str | None = None) -> Builder:
        return self._add(Block("code", code, language=language))

    def items(self, texts: list[str], ordered: bool = False) -> Builder:
        return self._add(Block("list", ordered=ordered, items=list(texts)))

    def table(self, rows: list[list[str]]) -> Builder:
        return self._add(Block("table", rows=[list(r) for r in rows]))

    def quote(self, blocks: list[Block], attribution: str | None = None) -> Builder:
        return self._add(Block("quote", blocks=list(blocks), attribution=attribution))

    def figure(self, caption: str = "") -> Builder:
        return self._add(Block("figure", caption))

    def rule(self) -> Builder:
        return self._add(Block("horizontal_rule"))

    def build(self) -> Document:
        return self.document
