"""Longest-prefix byte tokenizer: vocabulary lines, encoding, decoding, special ids."""

from __future__ import annotations

import re
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexweave.functions.memory import release
from lexweave.functions.trie import NoToken, Trie, encode_column, flat, lists

# The id spaces of the token format. Ids 1..256 are the bytes 0..255, 0 ends a text and is never emitted.
FILE_IDS = 65530
PAD, BOS, EOS = 65530, 65531, 65532
LANGUAGES = ("en", "pt_BR", "zh_Hans")
LANGUAGE_TAGS = {"en": 65533, "pt_BR": 65534, "zh_Hans": 65535}
VOCABULARY_SIZE = 65536

_ESCAPE = re.compile(r"""\\(?:([\\'"nrt])|x(.{2})|u(.{4})|U(.{8})|(.?))|([^\\]+)""", re.S)
_SIMPLE = {"n": "\n", "r": "\r", "t": "\t"}


class TokenizerError(ValueError):
    """A vocabulary file that doesn't hold what it should; the message begins with the line."""


def is_special(token: Column) -> Column:
    return (token == 0) | (token >= FILE_IDS)


def unescape(literal: str) -> bytes | None:
    """Bytes of a quoted literal, ``'...'``, ``"..."`` or ``b'...'``; None if it is malformed. In a bytes literal only
    ``\\x`` gives raw bytes and ``\\u`` is refused; elsewhere hexadecimal escapes are code points."""
    raw = literal.startswith("b")
    quoted = literal[1:] if raw else literal
    if len(quoted) < 2 or quoted[0] not in "'\"" or quoted[-1] != quoted[0]:
        return None
    out = bytearray()
    for simple, x, u, U, bad, plain in _ESCAPE.findall(quoted[1:-1]):
        if plain:
            out += plain.encode()
        elif simple:
            out += _SIMPLE.get(simple, simple).encode()
        elif digits := x or u or U:
            if not re.fullmatch(r"\+?[0-9a-fA-F]+", digits) or (raw and not x):
                return None
            value = int(digits, 16)
            if raw:
                out.append(value)
            elif value < 0x110000 and not 0xD800 <= value < 0xE000:
                out += chr(value).encode()
            else:
                return None
        else:
            return None
    return bytes(out)


def parse_line(line: str) -> tuple[int, bytes] | str:
    """(id, bytes) of one vocabulary line ``<id> <literal> <byte length>``, or what is wrong with it."""
    head, space, rest = line.partition(" ")
    if not space:
        return "no space after the id"
    literal, space, size = rest.rpartition(" ")
    if not space:
        return "no length"
    if not re.fullmatch(r"\+?[0-9]+", head):
        return "the id is no number"
    if not re.fullmatch(r"\+?[0-9]+", size):
        return "the length is no number"
    if not 1 <= int(head) < FILE_IDS:
        return "the id lies outside 1..65529"
    data = unescape(literal)
    if data is None:
        return "malformed literal"
    if len(data) != int(size):
        return f"{len(data)} bytes where {int(size)} are declared"
    return int(head), data


def parse_vocabulary(text: str) -> dict[int, bytes]:
    """id -> bytes of a whole file; of an id's several lines the last counts."""
    table: dict[int, bytes] = {}
    for number, line in enumerate(text.split("\n"), 1):
        line = line.removesuffix("\r")
        if line:
            found = parse_line(line)
            if isinstance(found, str):
                raise TokenizerError(f"line {number}: {found}")
            table[found[0]] = found[1]
    return table


def byte_table() -> dict[int, bytes]:
    """The 256 bytes alone."""
    return {b + 1: bytes([b]) for b in range(256)}


#: Bytes of text that are followed at a time.
PIECE = 1 << 20


def pieces(column: pa.Array):
    """Slices of a binary column of about PIECE bytes; a longer text is a slice of its own."""
    size, low = 0, 0
    for i, n in enumerate(pc.binary_length(column).fill_null(0).to_pylist()):
        if size and size + n > PIECE:
            yield column.slice(low, i - low)
            low, size = i, 0
        size += n
    if low < len(column):
        yield column.slice(low)


def _encoded(shared, piece: pa.Array) -> pa.Array:
    try:
        return encode_column(shared.value, piece)
    except NoToken as error:
        raise TokenizerError(str(error)) from None


class Tokenizer:
    """A token table: a compiled trie that the executors share, and one blob of all tokens' bytes for the way back, which
    needs no Python. The table has at most 65,529 rows."""

    def __init__(self, spark: SparkSession, table: Mapping[int, bytes] | None = None):
        self.spark, self.table = spark, dict(table if table is not None else byte_table())
        if any(not 1 <= t < FILE_IDS for t in self.table):
            raise TokenizerError("ids must lie in 1..65529")
        self._only_bytes = self.table == byte_table()
        self._shared = None if self._only_bytes else spark.sparkContext.broadcast(Trie(self.table))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Tokenizer:
        """From a vocabulary file in any store that Spark reads."""
        rows = spark.read.text(path, wholetext=True).collect()  # one small file
        if len(rows) != 1:
            raise TokenizerError(f"{path}: {len(rows)} files")
        return cls(spark, parse_vocabulary(rows[0][0]))

    def encode(self, text: Column) -> Column:
        """Ids of a text, an array without specials."""
        shared = self._shared

        @F.arrow_udf("array<int>")
        def run(raw: pa.Array) -> pa.Array:
            if shared is None:  # a byte's id is the byte and one
                data, offsets, nulls = flat(raw)
                return lists(data.astype(np.int32) + 1, offsets, nulls)
            parts = [_encoded(shared, piece) for piece in pieces(raw)]
            ids = pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))
            del parts
            release()
            return ids

        return run(text.cast("binary"))

    def count(self, text: Column) -> Column:
        """How many ids a text has."""
        if self._only_bytes:
            return F.octet_length(text)
        shared = self._shared

        @F.arrow_udf("int")
        def run(raw: pa.Array) -> pa.Array:
            parts = [pc.list_value_length(_encoded(shared, piece)) for piece in pieces(raw)]
            return pa.concat_arrays(parts) if parts else pa.array([], pa.int32())

        return run(text.cast("binary"))

    def used(self, df: DataFrame, *texts: str) -> DataFrame:
        """token_id: the ids that the text columns hold, some of them several times; no text's ids leave the Python worker."""
        shared, only_bytes = self._shared, self._only_bytes

        def run(batches):
            for batch in batches:
                seen = np.zeros(VOCABULARY_SIZE, dtype=bool)
                for column in batch.columns:
                    for piece in pieces(column):
                        seen[flat(piece)[0].astype(np.int32) + 1 if only_bytes else _encoded(shared, piece).flatten().to_numpy()] = True
                yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen), pa.int32())], ["token_id"])

        return df.select(*[F.col(c).cast("binary").alias(c) for c in texts]).mapInArrow(run, "token_id int")

    def frame(self) -> DataFrame:
        """token_id, bytes: the table as rows."""
        return self.spark.createDataFrame(sorted((k, bytearray(v)) for k, v in self.table.items()), "token_id int, bytes binary")

    def token_bytes(self, token: Column) -> Column:
        """Bytes of a token; null for a special or unknown one."""
        if self._only_bytes:
            return F.when(token.between(1, 256), F.unhex(F.lpad(F.hex((token - 1).cast("long")), 2, "0")))
        found = self._bytes(token)
        return F.when(F.get(self._sizes(), token) >= 0, found)

    def _numbers(self, numbers: list[int]) -> Column:
        """An array literal: one string, which the optimizer folds once."""
        return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<int>")

    def _sizes(self) -> Column:
        """By id: the token's length, -1 for none."""
        return self._numbers([len(self.table[t]) if t in self.table else -1 for t in range(max(self.table, default=0) + 1)])

    def _starts(self) -> Column:
        """By id: where its bytes begin in the blob, from 1."""
        out, place = [], 1
        for t in range(max(self.table, default=0) + 1):
            out.append(place)
            place += len(self.table.get(t, b""))
        return self._numbers(out)

    def _bytes(self, token: Column) -> Column:
        """A token's bytes cut out of the blob of all tokens in the order of their ids; null beyond them."""
        blob = F.lit(bytearray(b"".join(self.table[t] for t in sorted(self.table))))
        return F.substring(blob, F.get(self._starts(), token), F.greatest(F.get(self._sizes(), token), F.lit(0)))

    def decode(self, ids: Column) -> Column:
        """Text of an array of ids; specials and ids without a token are skipped, what is no UTF-8 becomes U+FFFD. Column functions only."""
        kept = F.filter(ids, lambda t: ~is_special(t))
        if self._only_bytes:
            digits = F.transform(kept, lambda t: F.lpad(F.hex((t - 1).cast("long")), 2, "0"))
        else:
            digits = F.transform(kept, lambda t: F.coalesce(F.hex(self._bytes(t)), F.lit("")))
        return F.make_valid_utf8(F.unhex(F.array_join(digits, "")).cast("string"))
