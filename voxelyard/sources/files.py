"""Files of any store that pyarrow reaches, for writers and readers of formats that Spark has not."""

from __future__ import annotations


def store_of(uri: str):
    """pyarrow's file system for a URI and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith(("/", "file:")) else f"/{uri}")


def write_bytes(uri: str, data: bytes) -> None:
    store, path = store_of(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(path, compression=None) as out:
        out.write(data)
