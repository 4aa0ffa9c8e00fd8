"""The container of compiled assemblies: portable executables with ECMA-335 metadata, as tables of rows.

The layout of every table is derived from one description of its columns; rows are decoded when a table is first asked for.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from functools import cached_property

from ..errors import QueryError

# fixed values (ECMA-335 II.22): the tables by number, and the columns of each. 2 and 4 are bytes; S, G and B offsets into the heaps of
# strings, GUIDs and blobs; a name is a row of that table, or of one of several tables as CODED says.
TABLES = {
    0x00: ("Module", "2 S G G G"), 0x01: ("TypeRef", "ResolutionScope S S"), 0x02: ("TypeDef", "4 S S TypeDefOrRef Field MethodDef"), 0x03: ("FieldPtr", "Field"), 0x04: ("Field", "2 S B"),
    0x05: ("MethodPtr", "MethodDef"), 0x06: ("MethodDef", "4 2 2 S B Param"), 0x07: ("ParamPtr", "Param"), 0x08: ("Param", "2 2 S"), 0x09: ("InterfaceImpl", "TypeDef TypeDefOrRef"),
    0x0A: ("MemberRef", "MemberRefParent S B"), 0x0B: ("Constant", "2 HasConstant B"), 0x0C: ("CustomAttribute", "HasCustomAttribute CustomAttributeType B"), 0x0D: ("FieldMarshal", "HasFieldMarshal B"),
    0x0E: ("DeclSecurity", "2 HasDeclSecurity B"), 0x0F: ("ClassLayout", "2 4 TypeDef"), 0x10: ("FieldLayout", "4 Field"), 0x11: ("StandAloneSig", "B"), 0x12: ("EventMap", "TypeDef Event"),
    0x13: ("EventPtr", "Event"), 0x14: ("Event", "2 S TypeDefOrRef"), 0x15: ("PropertyMap", "TypeDef Property"), 0x16: ("PropertyPtr", "Property"), 0x17: ("Property", "2 S B"),
    0x18: ("MethodSemantics", "2 MethodDef HasSemantics"), 0x19: ("MethodImpl", "TypeDef MethodDefOrRef MethodDefOrRef"), 0x1A: ("ModuleRef", "S"), 0x1B: ("TypeSpec", "B"),
    0x1C: ("ImplMap", "2 MemberForwarded S ModuleRef"), 0x1D: ("FieldRVA", "4 Field"), 0x1E: ("EncLog", "4 4"), 0x1F: ("EncMap", "4"), 0x20: ("Assembly", "4 2 2 2 2 4 B S S"), 0x21: ("AssemblyProcessor", "4"),
    0x22: ("AssemblyOS", "4 4 4"), 0x23: ("AssemblyRef", "2 2 2 2 4 B S S B"), 0x24: ("AssemblyRefProcessor", "4 AssemblyRef"), 0x25: ("AssemblyRefOS", "4 4 4 AssemblyRef"), 0x26: ("File", "4 S B"),
    0x27: ("ExportedType", "4 4 S S Implementation"), 0x28: ("ManifestResource", "4 4 S Implementation"), 0x29: ("NestedClass", "TypeDef TypeDef"), 0x2A: ("GenericParam", "2 2 TypeOrMethodDef S"),
    0x2B: ("MethodSpec", "MethodDefOrRef B"), 0x2C: ("GenericParamConstraint", "GenericParam TypeDefOrRef"),
}
# fixed values (ECMA-335 II.24.2.6): what the low bits of a coded index mean; a dash is a value that isn't used
CODED = {
    "TypeDefOrRef": "TypeDef TypeRef TypeSpec", "HasConstant": "Field Param Property", "HasFieldMarshal": "Field Param", "HasDeclSecurity": "TypeDef MethodDef Assembly",
    "HasCustomAttribute": "MethodDef Field TypeRef TypeDef Param InterfaceImpl MemberRef Module DeclSecurity Property Event StandAloneSig ModuleRef TypeSpec Assembly AssemblyRef File ExportedType ManifestResource GenericParam GenericParamConstraint MethodSpec",
    "MemberRefParent": "TypeDef TypeRef ModuleRef MethodDef TypeSpec", "HasSemantics": "Event Property", "MethodDefOrRef": "MethodDef MemberRef", "MemberForwarded": "Field MethodDef",
    "Implementation": "File AssemblyRef ExportedType", "CustomAttributeType": "- - MethodDef MemberRef -", "ResolutionScope": "Module ModuleRef AssemblyRef TypeRef", "TypeOrMethodDef": "TypeDef MethodDef",
}
NUMBERS = {name: n for n, (name, _) in TABLES.items()}
CODED_TABLES = {name: tables.split() for name, tables in CODED.items()}
CODED_BITS = {name: (len(tables) - 1).bit_length() for name, tables in CODED_TABLES.items()}

Row = tuple[str, int]  # a table and a row from 1


def malformed(why: str) -> QueryError:
    return QueryError("source_invalid", f"malformed assembly: {why}")


def widths(counts: dict[str, int], heap_sizes: int) -> dict[str, int]:
    """The bytes of each kind of column, as the numbers of rows and the sizes of heaps make them."""
    out = {"2": 2, "4": 4, **{heap: 4 if heap_sizes & bit else 2 for heap, bit in (("S", 1), ("G", 2), ("B", 4))}}
    out |= {name: 4 if counts.get(name, 0) > 0xFFFF else 2 for name in NUMBERS}
    for name, tables in CODED_TABLES.items():
        most = max(counts.get(t, 0) for t in tables)
        out[name] = 4 if most >= 1 << (16 - CODED_BITS[name]) else 2
    return out


class Assembly:
    """Rows and heaps of an assembly; a QueryError for bytes that are none."""

    def __init__(self, content: bytes):
        self._data = content
        try:
            root = self._metadata()
            self._streams = self._find_streams(root)
            self._lay_out()
        except (struct.error, IndexError) as e:
            raise malformed("it ends early") from e

    def _metadata(self) -> int:
        d = self._data
        if d[:2] != b"MZ":
            raise malformed("no executable")
        at = struct.unpack_from("<I", d, 0x3C)[0]
        if d[at : at + 4] != b"PE\0\0":
            raise malformed("no PE signature")
        sections, optional = struct.unpack_from("<H", d, at + 6)[0], struct.unpack_from("<H", d, at + 20)[0]
        header = at + 24
        wide = struct.unpack_from("<H", d, header)[0] == 0x20B
        directories = header + (112 if wide else 96)
        if struct.unpack_from("<I", d, directories - 4)[0] < 15:
            raise malformed("no managed metadata")
        self._sections = [struct.unpack_from("<IIII", d, header + optional + 40 * i + 8) for i in range(sections)]
        cli = struct.unpack_from("<I", d, directories + 8 * 14)[0]
        if not cli:
            raise malformed("no managed metadata")
        return self._place(struct.unpack_from("<I", d, self._place(cli) + 8)[0])

    def _place(self, address: int) -> int:
        for size, start, raw_size, raw in self._sections:
            if start <= address < start + max(size, raw_size):
                return raw + address - start
        raise malformed("an address outside all sections")

    def _find_streams(self, root: int) -> dict[str, bytes]:
        d = self._data
        if d[root : root + 4] != b"BSJB":
            raise malformed("no metadata root")
        at = root + 16 + struct.unpack_from("<I", d, root + 12)[0]
        out = {}
        n, at = struct.unpack_from("<H", d, at + 2)[0], at + 4
        for _ in range(n):
            offset, size = struct.unpack_from("<II", d, at)
            end = d.index(b"\0", at + 8)
            if root + offset + size > len(d):
                raise malformed("a stream beyond its end")
            out[d[at + 8 : end].decode("ascii", "replace")] = d[root + offset : root + offset + size]
            at = at + 8 + (end - at - 8) // 4 * 4 + 4
        return out

    def _lay_out(self) -> None:
        tables = self._streams.get("#~") or self._streams.get("#-")
        if tables is None:
            raise malformed("no tables")
        valid, at = struct.unpack_from("<Q", tables, 8)[0], 24
        present = [n for n in range(64) if valid >> n & 1]
        if any(n not in TABLES for n in present):
            raise malformed("an unknown table")
        self.counts: dict[str, int] = {}
        for n in present:
            self.counts[TABLES[n][0]] = struct.unpack_from("<I", tables, at)[0]
            at += 4
        width = widths(self.counts, tables[6])
        self._spans = {}
        for n in present:
            name, columns = TABLES[n]
            row = struct.Struct("<" + "".join("H" if width[c] == 2 else "I" for c in columns.split()))
            end = at + row.size * self.counts[name]
            if end > len(tables):
                raise malformed("a table beyond its end")
            self._spans[name] = (row, columns.split(), tables[at:end])
            at = end
        self._rows: dict[str, list[tuple]] = {}

    def rows(self, table: str) -> list[tuple]:
        """All rows; heaps' offsets and rows of one table as numbers, coded indexes as (table, row), row 0 being none."""
        if table not in self._rows:
            row, columns, data = self._spans.get(table, (None, [], b""))
            found = list(row.iter_unpack(data)) if row else []
            for i, c in enumerate(columns):
                if c in CODED_TABLES:
                    kinds, bits = CODED_TABLES[c], CODED_BITS[c]
                    mask = (1 << bits) - 1
                    found = [r[:i] + ((kinds[r[i] & mask] if r[i] & mask < len(kinds) else "-", r[i] >> bits),) + r[i + 1 :] for r in found]
            self._rows[table] = found
        return self._rows[table]

    def row(self, table: str, n: int) -> tuple:
        rows = self.rows(table)
        if not 0 < n <= len(rows):
            raise malformed(f"row {n} of {table}")
        return rows[n - 1]

    def owned(self, table: str, owners: str, column: int, owner: int) -> range:
        """The rows of ``table`` from where an owner's column points to where the next one's does."""
        rows = self.rows(owners)
        first = rows[owner - 1][column]
        last = rows[owner][column] if owner < len(rows) else self.counts.get(table, 0) + 1
        return range(first, min(last, self.counts.get(table, 0) + 1)) if first else range(0)

    def string(self, at: int) -> str:
        heap = self._streams.get("#Strings", b"")
        end = heap.find(b"\0", at)
        if at >= len(heap) or end < 0:
            raise malformed("a string beyond its heap")
        return heap[at:end].decode("utf-8", "replace")

    def blob(self, at: int) -> bytes:
        heap = self._streams.get("#Blob", b"")
        r = Bytes(heap, at)
        return r.take(r.packed())

    @cached_property
    def attributes(self) -> dict[Row, list[tuple[Row, int]]]:
        """(constructor, value) of the attributes of each row that has any."""
        out = defaultdict(list)
        for parent, constructor, value in self.rows("CustomAttribute"):
            out[parent].append((constructor, value))
        return out

    @cached_property
    def enclosing(self) -> dict[int, int]:
        return dict(self.rows("NestedClass"))

    @cached_property
    def generic_parameters(self) -> dict[Row, list[tuple[int, int, int, int]]]:
        """(place, flags, name, row) of each owner's, in order."""
        out = defaultdict(list)
        for n, (place, flags, owner, name) in enumerate(self.rows("GenericParam"), 1):
            out[owner].append((place, flags, name, n))
        return {k: sorted(v) for k, v in out.items()}

    @cached_property
    def semantics(self) -> dict[Row, list[tuple[int, int]]]:
        """(meaning, method) of each event and property."""
        out = defaultdict(list)
        for meaning, method, owner in self.rows("MethodSemantics"):
            out[owner].append((meaning, method))
        return out

    @cached_property
    def constants(self) -> dict[Row, tuple[int, bytes]]:
        return {owner: (kind & 0xFF, self.blob(value)) for kind, owner, value in self.rows("Constant")}


class Bytes:
    """A reading position in a blob."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    @property
    def left(self) -> int:
        return len(self.data) - self.at

    def take(self, n: int) -> bytes:
        if n < 0 or self.left < n:
            raise malformed("a blob that ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def byte(self) -> int:
        return self.take(1)[0]

    def number(self, form: str) -> int | float:
        return struct.unpack("<" + form, self.take(struct.calcsize(form)))[0]

    def packed(self) -> int:
        """An unsigned number in one, two or four bytes (II.23.2)."""
        first = self.byte()
        if first < 0x80:
            return first
        if first < 0xC0:
            return (first & 0x3F) << 8 | self.byte()
        if first < 0xE0:
            return int.from_bytes(bytes([first & 0x1F]) + self.take(3), "big")
        raise malformed("a packed number")

    def packed_signed(self) -> int:
        """The lowest bit is the sign, rotated there over the bits of the stored size."""
        start = self.at
        n = self.packed()
        bits = {1: 6, 2: 13, 4: 28}[self.at - start]
        return (n >> 1) - (1 << bits) if n & 1 else n >> 1

    def text(self) -> str | None:
        """A string with its length; none for the byte 0xFF."""
        if self.left and self.data[self.at] == 0xFF:
            self.at += 1
            return None
        return self.take(self.packed()).decode("utf-8", "replace")
