"""Table functions for SQL: ``FROM docs, LATERAL md_blocks(docs.text)``.

``register`` gives a session ``md_blocks(text)``, the blocks of a Markdown text with what
protection makes of them, and ``xml_slots(text)``, the translatable texts of an XML topic.
Workers get and give Arrow batches; a null text has no rows, an XML text that cannot be
parsed one with ``error``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from docweave.operators.blocks import blocks_of
from docweave.operators.dita import ET, prepare
from docweave.operators.protect import Protector


class MarkdownBlocks:
    def eval(self, text: str) -> Iterator[tuple]:
        if text is None:
            return
        found = blocks_of(text)
        for (place, kind, protected, made, translatable, _), (_, raw, _) in zip(Protector().document(found), found, strict=True):
            yield place, kind, raw, protected, len(made), translatable


class XmlSlots:
    def eval(self, text: str) -> Iterator[tuple]:
        if text is None:
            return
        try:
            for b in prepare(text):
                yield b["block_index"], b["tag_name"], b["field_name"], b["protected_text"], None
        except (ET.ParseError, ValueError) as error:
            yield None, None, None, None, f"parse_document: {error}"


def register(spark: SparkSession) -> None:
    blocks = udtf(MarkdownBlocks, returnType="block_index int, block_type string, raw_text string, protected_text string, tokens int, translatable boolean", useArrow=True)
    slots = udtf(XmlSlots, returnType="slot int, tag_name string, field_name string, protected_text string, error string", useArrow=True)
    spark.udtf.register("md_blocks", blocks)
    spark.udtf.register("xml_slots", slots)
