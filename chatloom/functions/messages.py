"""Expressions over chat messages: building them, recognising ready-made ones, reading their text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatloom.functions import images
from chatloom.functions.columns import let
from chatloom.functions.text import is_blank, py_text
from chatloom.schemas import message_type, part_type

# Fixed value: what a text must look like before it is tried as a JSON message.
MESSAGE_JSON = r'(?s)^\s*\{.*"role".*"content".*\}\s*$'


def text_part(text: Column, vision: bool = False) -> Column:
    fields = [F.lit("text").alias("type"), text.alias("text")]
    if vision:
        fields.append(F.lit(None).cast(part_type(True)["image"].dataType).alias("image"))
    return F.struct(*fields)


def image_part(image: Column) -> Column:
    return F.struct(
        F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"), image.alias("image")
    )


def no_parts(vision: bool) -> Column:
    return F.array().cast(T.ArrayType(part_type(vision)))


def text_parts(text: Column, vision: bool = False, drop_blank: bool = True) -> Column:
    """One text part, or none where the text is empty (or blank)."""
    given = (lambda p: ~is_blank(p["text"])) if drop_blank else (lambda p: p["text"] != "")
    return F.filter(F.array(text_part(text, vision)), given)


def message(role: str, parts: Column) -> Column:
    """The message, or null where there is nothing in it."""
    built = F.filter(
        F.array(F.struct(F.lit(role).alias("role"), parts.alias("content"))),
        lambda m: F.size(m["content"]) > 0,
    )
    return F.get(built, F.lit(0))


def _json_message(doc: Column, vision: bool) -> Column:
    content = F.try_variant_get(doc, "$.content", "variant")

    def build(c: Column) -> Column:
        kind = F.schema_of_variant(c)
        listed = F.transform(F.try_variant_get(c, "$", "array<variant>"), lambda p: _listed_part(p, vision))
        plain = (
            F.when(kind == "VOID", F.lit("None"))
            .when(kind == "BOOLEAN", F.initcap(F.try_variant_get(c, "$", "string")))
            .when(kind.startswith("OBJECT"), F.to_json(c))
            .otherwise(F.try_variant_get(c, "$", "string"))
        )
        parts = F.when(kind.startswith("ARRAY"), listed).otherwise(F.array(text_part(plain, vision)))
        return F.when(
            c.isNotNull(),
            F.struct(F.try_variant_get(doc, "$.role", "string").alias("role"), parts.alias("content")),
        )

    has_role = F.try_variant_get(doc, "$.role", "variant").isNotNull()
    return F.when(has_role, let(content, build))


def _listed_part(p: Column, vision: bool) -> Column:
    """A list item: an object with type, text and image, or anything else as text."""
    given = lambda name: F.try_variant_get(p, f"$.{name}", "string")
    fields = [given("type").alias("type"), given("text").alias("text")]
    if vision:
        payload = images.image_bytes(given("image"), T.StringType())
        fields.append(images.image_struct(payload).alias("image"))
    is_object = F.schema_of_variant(p).startswith("OBJECT")
    return F.when(is_object, F.struct(*fields)).otherwise(text_part(F.try_variant_get(p, "$", "string"), vision))


def _struct_message(c: Column, dtype: T.StructType, vision: bool) -> Column:
    content, ctype = c["content"], dtype["content"].dataType
    if isinstance(ctype, T.ArrayType):
        item = ctype.elementType
        if isinstance(item, T.StructType):
            def part(p: Column) -> Column:
                fields = [
                    (p[n] if n in item.names else F.lit(None)).cast("string").alias(n) for n in ("type", "text")
                ]
                if vision:
                    payload = (
                        images.image_struct(images.image_bytes(p["image"], item["image"].dataType))
                        if "image" in item.names
                        else F.lit(None).cast(part_type(True)["image"].dataType)
                    )
                    fields.append(payload.alias("image"))
                return F.struct(*fields)

            parts = F.transform(content, part)
        else:
            parts = F.transform(content, lambda t: text_part(py_text(t, item, "None"), vision))
    else:
        parts = F.array(text_part(py_text(content, ctype, "None"), vision))
    return F.when(c.isNotNull(), F.struct(c["role"].cast("string").alias("role"), parts.alias("content")))


def preformatted(c: Column, dtype: T.DataType, vision: bool = False) -> Column | None:
    """The message a value already is (a role/content struct, or JSON text of one), null where it is none.
    ``None`` when values of this type never are."""
    if isinstance(dtype, T.StructType) and {"role", "content"} <= set(dtype.names):
        return _struct_message(c, dtype, vision).cast(message_type(vision))
    if isinstance(dtype, T.StringType):
        parsed = let(F.try_parse_json(c), lambda doc: _json_message(doc, vision))
        return F.when(c.rlike(MESSAGE_JSON), parsed).cast(message_type(vision))
    return None


def has_role(messages: Column, role: str) -> Column:
    return F.exists(messages, lambda m: m["role"] == role)


def is_legacy(messages_dtype: T.DataType) -> bool:
    """Whether ``content`` is a plain string instead of a list of parts."""
    return isinstance(messages_dtype.elementType["content"].dataType, T.StringType)


def wrap_legacy(messages: Column) -> Column:
    """String contents become a single text part."""
    return F.transform(
        messages, lambda m: F.struct(m["role"].alias("role"), F.array(text_part(m["content"])).alias("content"))
    )


def message_text(m: Column, legacy: bool = False, sep: str = " ") -> Column:
    """Text of one message: its text parts joined, a placeholder JSON for other parts."""
    if legacy:
        return F.coalesce(m["content"], F.lit(""))
    return F.array_join(
        F.transform(
            F.coalesce(m["content"], F.array()),
            lambda p: F.when(p["type"] == "text", F.coalesce(p["text"], F.lit(""))).otherwise(
                F.coalesce(F.to_json(p), F.lit(""))
            ),
        ),
        sep,
    )
