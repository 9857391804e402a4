"""Arrays in the cluster's shared folder, memory-mapped by workers, and hash tables made of them."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
from collections import OrderedDict

import numpy as np
import pyarrow.fs as pafs

_U = np.uint64


class Store:
    """Arrays by name in a folder of shared storage."""

    def __init__(self, uri: str):
        self.fs, self.root = pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}")

    def put(self, name: str, a: np.ndarray) -> None:
        """Written under a name of its own and then moved, so a task that runs twice does no harm."""
        self.fs.create_dir(self.root, recursive=True)
        own = f"{self.root}/.{name}.{os.getpid()}.{os.urandom(6).hex()}"
        with self.fs.open_output_stream(own) as out:
            out.write(np.ascontiguousarray(a).data if len(a) else b"")
        self.fs.move(own, f"{self.root}/{name}")

    def get(self, name: str, dtype) -> np.ndarray:
        path = f"{self.root}/{name}"
        if self.fs.get_file_info(path).size in (0, None):
            return np.empty(0, dtype)
        if isinstance(self.fs, pafs.LocalFileSystem):
            return np.asarray(np.memmap(path, dtype, mode="r"))
        local = os.path.join(_local_copies(), f"{abs(hash(self.root))}-{name}")
        if not os.path.exists(local):
            own = f"{local}.{os.getpid()}"
            with self.fs.open_input_stream(path) as source, open(own, "wb") as out:
                shutil.copyfileobj(source, out, 1 << 20)
            os.replace(own, local)
        return np.asarray(np.memmap(local, dtype, mode="r"))


_copies: tempfile.TemporaryDirectory | None = None


def _local_copies() -> str:
    """A worker's own folder for copies from a store that cannot be mapped; it goes with the worker."""
    global _copies
    if _copies is None:
        _copies = tempfile.TemporaryDirectory(prefix="tidemark-arrays-")
    return _copies.name


#: Files that one reader keeps mapped; the system allows a process some 65,000 maps.
MAPPED = 4096


class Recent:
    """Values by key, made when they are wanted; only those used last are kept, and their maps with them."""

    def __init__(self, make):
        self.make, self.kept = make, OrderedDict()

    def __getitem__(self, key):
        if key in self.kept:
            self.kept.move_to_end(key)
        else:
            self.kept[key] = self.make(key)
            if len(self.kept) > MAPPED:
                self.kept.popitem(last=False)
        return self.kept[key]


class Bundle:
    """Named arrays in one file, which is written and mapped as a whole; ``put`` and ``get`` as of a Store."""

    def __init__(self):
        self.arrays: dict[str, np.ndarray] = {}

    def put(self, name: str, a: np.ndarray) -> None:
        self.arrays[name] = np.ascontiguousarray(a)

    def save(self, store: Store, file: str) -> None:
        places, at = {}, 0
        for name, a in self.arrays.items():
            places[name] = (at, a.nbytes)
            at += -(-a.nbytes // 8) * 8
        head = json.dumps(places).encode()
        head += b" " * (-len(head) % 8)
        out = np.zeros(8 + len(head) + at, np.uint8)
        out[:8] = np.frombuffer(np.int64(len(head)).tobytes(), np.uint8)
        out[8 : 8 + len(head)] = np.frombuffer(head, np.uint8)
        for name, a in self.arrays.items():
            first = 8 + len(head) + places[name][0]
            out[first : first + a.nbytes] = a.view(np.uint8).ravel()
        store.put(file, out)

    @classmethod
    def open(cls, store: Store, file: str) -> Bundle:
        out, mapped = cls(), store.get(file, np.uint8)
        if len(mapped):
            size = 8 + int(mapped[:8].view(np.int64)[0])
            out.arrays = {name: mapped[size + at : size + at + n] for name, (at, n) in json.loads(mapped[8:size].tobytes()).items()}
        return out

    def get(self, name: str, dtype) -> np.ndarray:
        return self.arrays[name].view(dtype) if name in self.arrays else np.empty(0, dtype)


class Sparse:
    """Non-negative numbers as one byte each, with those from 255 on listed apart."""

    def __init__(self, small: np.ndarray, at: np.ndarray, large: np.ndarray):
        self.small, self.at, self.large = small, at, large

    @staticmethod
    def put(store: Store | Bundle, name: str, values: np.ndarray) -> None:
        at = np.flatnonzero(values >= 255)
        store.put(name, np.minimum(values, 255).astype(np.uint8))
        if len(at):
            store.put(f"{name}-large", np.concatenate([at, values[at]]).astype(np.int64))

    @classmethod
    def get(cls, store: Store | Bundle, name: str) -> Sparse:
        at, large = store.get(f"{name}-large", np.int64).reshape(2, -1)
        return cls(store.get(name, np.uint8), at, large)

    def __getitem__(self, index: np.ndarray) -> np.ndarray:
        out = self.small[index].astype(np.int64)
        full = np.flatnonzero(out == 255)
        if len(full):
            out[full] = self.large[np.searchsorted(self.at, index[full])]
        return out


class HashArray:
    """A sorted array of hashes: the upper bits by an index of where each begins, 32 bits each beside it.

    With ``n`` hashes the index has about ``n / 16`` places, so 32 + log2(n / 16) bits of each hash count
    and a hash that is not stored is taken for a stored one with a chance of about 1 in 2 ** 28.
    """

    def __init__(self, index: np.ndarray, low: np.ndarray):
        self.index, self.low = index, low

    @staticmethod
    def put(store: Store | Bundle, name: str, hashes: np.ndarray) -> None:
        """``hashes`` are sorted."""
        bits = max(1, (len(hashes) >> 4).bit_length())
        upper = (hashes >> _U(64 - bits)).astype(np.int64)
        store.put(f"{name}-index", np.searchsorted(upper, np.arange((1 << bits) + 1)).astype(np.uint32))
        store.put(f"{name}-low", ((hashes << _U(bits)) >> _U(32)).astype(np.uint32))

    @classmethod
    def get(cls, store: Store | Bundle, name: str) -> HashArray:
        return cls(store.get(f"{name}-index", np.uint32), store.get(f"{name}-low", np.uint32))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        if not len(self.low):
            return np.full(len(hashes), -1)
        bits = (len(self.index) - 1).bit_length() - 1
        upper = (hashes >> _U(64 - bits)).astype(np.int64)
        want = ((hashes << _U(bits)) >> _U(32)).astype(np.uint32)
        at, end = self.index[upper].astype(np.int64), self.index[upper + 1].astype(np.int64)
        step = 1 << int((end - at).max(initial=0)).bit_length() >> 1
        while step:  # lower hashes are passed in steps of falling powers of two
            place = at + (step - 1)
            at += step * ((self.low.take(place, mode="clip") < want) & (place < end))
            step >>= 1
        return np.where((at < end) & (self.low.take(at, mode="clip") == want), at, -1)
