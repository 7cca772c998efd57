"""Rows to chat examples. Every mode is one projection plus one row test, so it keeps the input's partitioning,
prunes unread columns at the scan and runs unchanged on a streaming DataFrame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatloom.config import (
    LANGUAGE_MODELING,
    PREFERENCE,
    PROMPT_ONLY,
    FieldMapping,
    as_mappings,
    detect_modality,
    validate_mappings,
)
from chatloom.functions import images
from chatloom.functions import messages as M
from chatloom.functions.templates import TemplateFailure, compile_template
from chatloom.functions.text import normalize_ws, py_text
from chatloom.schemas import messages_type

_NOT_EXTRA = ("system_field", "user_field")


class _Fields:
    """Expressions for the mapped fields of one source schema."""

    def __init__(self, schema: T.StructType, vision: bool, normalize: bool, null_text: str):
        self.types = {f.name: f.dataType for f in schema.fields}
        self.vision, self.normalize, self.null_text = vision, normalize, null_text

    def rendered(self, name: str) -> Column:
        return py_text(F.col(f"`{name}`"), self.types[name], self.null_text)

    def tidy(self, text: Column) -> Column:
        return normalize_ws(text) if self.normalize else text

    def template(self, value: str) -> Column:
        return compile_template(value, {n: self.rendered(n) for n in self.types})

    def text(self, m: FieldMapping) -> Column:
        """Column text or rendered template; a template that cannot be rendered stands for itself."""
        if m.type == "column":
            return self.tidy(self.rendered(m.value))
        try:
            return self.tidy(self.template(m.value))
        except TemplateFailure:
            return self.tidy(F.lit(m.value))

    def ready_made(self, m: FieldMapping) -> Column | None:
        if m.type != "column":
            return None
        return M.preformatted(F.col(f"`{m.value}`"), self.types[m.value], self.vision)

    def image_parts(self, m: FieldMapping) -> Column:
        payload = images.image_bytes(F.col(f"`{m.value}`"), self.types[m.value])
        return F.transform(
            F.filter(F.array(images.image_struct(payload)), lambda i: i.isNotNull()), M.image_part
        )

    def system(self, m: FieldMapping) -> Column | None:
        """System text is taken as it is, without whitespace changes."""
        if m.type == "column":
            text = self.rendered(m.value)
        else:
            try:
                text = self.template(m.value)
            except TemplateFailure:
                return None
        return self._first_of(self.ready_made(m), M.message("system", M.text_parts(text, self.vision, drop_blank=False)))

    def user(self, m: FieldMapping | list[FieldMapping]) -> Column:
        if isinstance(m, list):
            parts = F.filter(
                F.flatten(F.array(*[p for p in map(self._item_parts, m) if p is not None] or [M.no_parts(self.vision)])),
                self._has_content,
            )
            return M.message("user", parts)
        if m.type == "image":
            return M.message("user", self.image_parts(m))
        return self._first_of(self.ready_made(m), M.message("user", M.text_parts(self.text(m), self.vision)))

    def assistant(self, m: FieldMapping) -> Column:
        regular = M.message("assistant", M.text_parts(self.text(m), self.vision, drop_blank=False))
        return self._first_of(self.ready_made(m), regular)

    def _item_parts(self, m: FieldMapping) -> Column | None:
        if m.type == "image":
            return self.image_parts(m)
        if m.type == "template":
            try:
                return M.text_parts(self.tidy(self.template(m.value)), self.vision)
            except TemplateFailure:
                return None
        ready = self.ready_made(m)
        regular = M.text_parts(self.text(m), self.vision)
        return regular if ready is None else F.coalesce(ready["content"], regular)

    def _has_content(self, p: Column) -> Column:
        kept = ~M.is_blank(p["text"])
        return F.coalesce(kept, F.lit(False)) | (p["image"].isNotNull() if self.vision else F.lit(False))

    @staticmethod
    def _first_of(ready: Column | None, regular: Column) -> Column:
        return regular if ready is None else F.coalesce(ready, regular)


def _present(dtype: T.ArrayType, *messages: Column | None) -> Column:
    given = [m for m in messages if m is not None]
    if not given:
        return F.array().cast(dtype)
    return F.filter(F.array(*given), lambda m: m.isNotNull()).cast(dtype)


def _kept_once(value: Column, test) -> Column:
    """Generator that drops rows failing the test. A plain filter would be pushed below the projection and
    compute the whole conversion a second time."""
    return F.explode(F.filter(F.array(value), test))


def to_chat(
    df: DataFrame,
    mode: str,
    mappings: Mapping,
    *,
    keep: Sequence[str] = (),
    normalize_whitespace: bool = True,
    null_text: str = "",
    include_system: bool = False,
) -> DataFrame:
    """``language_modeling`` gives ``messages``; ``prompt_only`` gives ``prompt`` and one text column per further
    mapping; ``preference`` gives ``prompt``, ``chosen`` and ``rejected``. Source columns are dropped except
    those in ``keep`` and a ``split`` column. Rows without the message the mode needs are dropped."""
    mappings = as_mappings(mappings)
    validate_mappings(mappings, df.columns, mode)
    vision = detect_modality(mappings) == "vision"
    f = _Fields(df.schema, vision, normalize_whitespace, null_text)
    dtype = messages_type(vision)
    kept = list(dict.fromkeys([*keep, *(["split"] if "split" in df.columns else [])]))
    keep_cols = [F.col(f"`{k}`") for k in kept]

    system = f.system(mappings["system_field"]) if "system_field" in mappings else None
    user = f.user(mappings["user_field"])

    if mode == LANGUAGE_MODELING:
        assistant = f.assistant(mappings["assistant_field"])
        return df.select(
            *keep_cols,
            _kept_once(
                _present(dtype, system, user, assistant),
                lambda ms: M.has_role(ms, "user") & M.has_role(ms, "assistant"),
            ).alias("messages"),
        )
    if mode == PROMPT_ONLY:
        extras = [f.text(m).alias(name) for name, m in mappings.items() if name not in _NOT_EXTRA]
        prompt = _kept_once(_present(dtype, system, user), lambda ms: F.size(ms) > 0)
        return df.select(*keep_cols, prompt.alias("prompt"), *extras)
    if mode == PREFERENCE:
        # a row needs its user message; the system message is extra and never saves a row without one
        prompt = _kept_once(_present(dtype, user), lambda ms: F.size(ms) > 0)
        sides = [
            _present(dtype, f.assistant(mappings[f"{side}_field"])).alias(side) for side in ("chosen", "rejected")
        ]
        if not (include_system and system is not None):
            return df.select(*keep_cols, prompt.alias("prompt"), *sides)
        with_system = df.select(*keep_cols, prompt.alias("prompt"), *sides, _present(dtype, system).alias("_system"))
        return with_system.withColumn("prompt", F.concat("_system", "prompt")).drop("_system")
    raise ValueError(f"unsupported processing mode: {mode}")


def drop_failed(df: DataFrame, column: str) -> DataFrame:
    """Rows whose list of messages is missing or empty are removed."""
    return df.filter(F.size(column) > 0)


def render_images(messages: Column) -> Column:
    """Messages with image payloads as data URLs; a payload that is no image reads ``[Image conversion failed]``."""

    def part(p: Column) -> Column:
        url = F.when(
            p["type"] == "image",
            F.coalesce(images.data_url(p["image"]["bytes"]), F.lit("[Image conversion failed]")),
        )
        return F.struct(p["type"].alias("type"), p["text"].alias("text"), url.alias("image"))

    return F.transform(
        messages,
        lambda m: F.struct(m["role"].alias("role"), F.transform(m["content"], part).alias("content")),
    )


def image_text_url(c: Column) -> Column:
    """Image given as text: a data URL stays, plain base64 gets the header its signature asks for."""
    subtype = F.coalesce(images.mime_subtype(images.decode_base64(c, pad=True)), F.lit("png"))
    return F.when(c.startswith("data:image"), c).otherwise(
        F.concat(F.lit("data:image/"), subtype, F.lit(";base64,"), c)
    )
