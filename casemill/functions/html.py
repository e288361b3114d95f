"""The signature block at the end of an HTML decision."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, functions as F

from casemill.functions.arrays import empty_texts, let
from casemill.functions.text import clean_lines
from casemill.rules.defaults import NO_TABLE, TRIAGE_PATTERN

# Names of character entities: those of markup, and of Latin-1 and its neighbours.
_ENTITIES = {
    name.rstrip(";"): char
    for name, char in html5.items()
    if name.endswith(";") and len(char) == 1 and (ord(char) < 256 or "\u2010" <= char <= "\u2026" or char in "ŒœŠšŸ€™")
}
# A reference by number or by name; the ampersand it stands for is not read again.
_REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def last_block(html: Column, tag: str = "table") -> Column:
    """Inner HTML of the block whose opening tag comes last; NULL when there is none or it is empty.

    Scripts, styles and comments are no markup and are left out first. The greedy prefix finds the
    last opening tag, so the innermost of nested blocks is taken; a block may be left unclosed.
    """
    markup = F.regexp_replace(
        html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", ""
    )
    pattern = rf"(?is)^.*<{tag}\b[^>]*>(.*?)(?:</{tag}\s*>|\z)"
    return F.nullif(F.regexp_extract(markup, pattern, 1), F.lit(""))


def block_text(block: Column) -> Column:
    """Text of an HTML fragment: tags dropped, character entities decoded."""
    names = F.create_map(*[F.lit(x) for pair in sorted(_ENTITIES.items()) for x in pair])

    def decoded(reference):
        body = F.substring(reference, F.lit(2), F.length(reference) - 2)
        number = F.when(body.rlike("^#[0-9]+$"), F.substring(body, 2, 7).cast("int")).when(
            body.rlike("^#[xX]"), F.conv(F.substring(body, 3, 6), 16, 10).cast("int")
        )
        # Four bytes for each character, so that numbers beyond 65,535 work too; invalid ones stay as they are.
        point = F.unhex(F.lpad(F.hex(number), 8, "0"))
        valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        return F.coalesce(F.when(valid, F.decode(point, "UTF-32")), names[body], reference)

    def whole(text):
        found = F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0))
        between = F.split(text, _REFERENCE, -1)
        pieces = F.zip_with(between, F.transform(found, decoded), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
        return F.when(text.rlike(_REFERENCE), F.array_join(pieces, "")).otherwise(text)

    return let(F.regexp_replace(block, r"(?s)<[^>]*>", ""), whole)


def signature_items(
    html: Column, tag: str = "table", triage: str = TRIAGE_PATTERN, item_pattern: str | None = None
) -> Column:
    """Lines of the last block, or the matches of ``item_pattern`` in them, each once.

    A line with a triage word means that the wrong block was found; without a block the list is
    empty.
    """
    lines = clean_lines(block_text(last_block(html, tag)))

    def items(found):
        if item_pattern is None:
            return found
        spans = F.transform(found, lambda x: F.regexp_extract_all(x, F.lit(item_pattern), F.lit(0)))
        return F.flatten(spans)

    return let(
        F.coalesce(lines, empty_texts()),
        lambda found: F.when(
            F.exists(found, lambda x: x.rlike(triage)), F.array(F.lit(NO_TABLE))
        ).otherwise(F.array_distinct(items(found))),
    )
