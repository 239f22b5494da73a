"""The binary collection, read and written whole by plain Python, for small inputs."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd

from anchorline.sources import collection as C


class CollectionReader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def number(self, kind: str) -> int:
        size = struct.calcsize(kind)
        if self.at + size > len(self.data):
            raise ValueError("the collection ends too early")
        self.at += size
        return struct.unpack_from("<" + kind, self.data, self.at - size)[0]

    def name(self) -> str:
        end = self.data.find(b"\0", self.at)
        if end < 0:
            raise ValueError("the collection ends too early")
        text = self.data[self.at : end].decode()
        self.at = end + 1
        return text

    def rows(self, n: int) -> np.ndarray:
        if self.at + n * C.ROW.itemsize > len(self.data):
            raise ValueError("the collection ends too early")
        self.at += n * C.ROW.itemsize
        return np.frombuffer(self.data, C.ROW, n, self.at - n * C.ROW.itemsize)


def decode_collection(data: bytes) -> tuple[pd.DataFrame, dict[str, int]]:
    """Blocks and genome sizes of a collection's bytes."""
    r = CollectionReader(data)
    if (version := r.number("B")) != C.VERSION:
        raise ValueError(f"version {version} of the collection isn't supported")
    if r.number("H") != C.MAGIC:
        raise ValueError("the collection has another byte order")
    parts: list[tuple] = []
    sizes: dict[str, int] = {}
    for _ in range(r.number("B")):
        ref = r.name()
        sizes[ref] = r.number("Q")
        for _ in range(r.number("B")):
            qry = r.name()
            for _ in range(r.number("I")):
                chrom, n = r.number("I"), r.number("I")
                parts.append((ref, qry, chrom, r.rows(n)))
    chroms = np.array([r.name() for _ in range(r.number("I"))], object)
    if r.at != len(data):
        raise ValueError("bytes follow the end of the collection")
    frames = [
        pd.DataFrame({"ref_sp": ref, "qry_sp": qry, "ref_chrom": chroms[chrom], "ref_start": b["ref_start"].astype(np.int64), "qry_chrom": chroms[b["qry_chrom"]], "qry_start": b["qry_start"].astype(np.int64), "length": (b["word"] & 0x7FFF).astype(np.int32), "qry_rev": (b["word"] & 0x8000) != 0})
        for ref, qry, chrom, b in parts
    ]
    names = [x.split()[0] for x in C.SCHEMA.split(", ")]
    return (pd.concat(frames, ignore_index=True) if frames else pd.DataFrame(columns=names))[names], sizes


def encode_collection(blocks: pd.DataFrame, sizes: dict[str, int]) -> bytes:
    """The bytes of a collection; ids of chromosomes follow their first appearance."""
    if len(sizes) > 255:
        raise ValueError("more than 255 species")
    ids: dict[str, int] = {}
    out = [struct.pack("<BHB", C.VERSION, C.MAGIC, len(sizes))]
    name = lambda s: s.encode() + b"\0"
    for ref, size in sizes.items():
        own = blocks[blocks["ref_sp"] == ref]
        partners = list(dict.fromkeys(own["qry_sp"]))
        out.append(name(ref) + struct.pack("<QB", size, len(partners)))
        for qry in partners:
            pair = own[own["qry_sp"] == qry]
            chroms = list(dict.fromkeys(pair["ref_chrom"]))
            out.append(name(qry) + struct.pack("<I", len(chroms)))
            for chrom in chroms:
                b = pair[pair["ref_chrom"] == chrom].sort_values(["ref_start", "qry_chrom", "qry_start"], kind="stable")
                rows = np.zeros(len(b), C.ROW)
                code = ids.setdefault(chrom, len(ids))
                rows["ref_start"], rows["qry_start"] = b["ref_start"], b["qry_start"]
                rows["qry_chrom"] = [ids.setdefault(c, len(ids)) for c in b["qry_chrom"]]
                rows["word"] = b["length"].to_numpy() | np.where(b["qry_rev"], 0x8000, 0)
                out.append(struct.pack("<II", code, len(b)) + rows.tobytes())
    out.append(struct.pack("<I", len(ids)) + b"".join(map(name, ids)))
    return b"".join(out)
