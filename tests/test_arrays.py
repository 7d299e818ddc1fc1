"""Array files by byte ranges."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.sources.arrays import scan_arrays


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out, rng = tmp_path_factory.mktemp("arrays"), np.random.default_rng(1)
    arrays = {"a": rng.random((50, 80)), "f": np.asfortranarray(rng.random((30, 20))), "c": rng.integers(0, 255, (12, 9, 3)).astype(np.uint8)}
    for name, x in arrays.items():
        np.save(out / f"{name}.npy", x)
    np.savez(out / "s.npz", other=np.ones((4, 4)), image=arrays["a"])
    np.savez_compressed(out / "z.npz", arrays["f"])
    return out, arrays


def values(rows):
    return {(r.y, r.x, r.channel): r.v for r in rows}


@pytest.mark.parametrize("cells", ["7", "1000", "1000000"])
def test_every_layout(spark, folder, cells):
    out, arrays = folder
    rows = scan_arrays(spark, f"file://{out}", cells=cells).collect()
    for name, own in (("a.npy", "a"), ("f.npy", "f"), ("c.npy", "c"), ("s.npz", "a"), ("z.npz", "f")):
        array = arrays[own].reshape(*arrays[own].shape, 1)[..., :3] if arrays[own].ndim == 2 else arrays[own]
        assert values(r for r in rows if r.path.endswith(f"/{name}")) == {tuple(map(int, at)): float(array[tuple(at)]) for at in np.argwhere(np.ones(array.shape))}


def test_a_window_reads_its_bytes_only(spark, folder):
    out, arrays = folder
    window = scan_arrays(spark, f"file://{out}/a.npy", cells="800").where("y >= 12 AND y < 25 AND x BETWEEN 3 AND 9")
    rows = window.collect()
    assert values(rows) == {(y, x, 0): arrays["a"][y, x] for y in range(12, 25) for x in range(3, 10)}
    read = {(r.bytes_from, r.bytes) for r in rows}
    assert sum(n for _, n in read) == 13 * 7 * 8  # of 32,000
    offset = (out / "a.npy").stat().st_size - 50 * 80 * 8
    assert min(a for a, _ in read) == offset + (12 * 80 + 3) * 8
    wide = scan_arrays(spark, f"file://{out}/s.npz").where("y = 49").collect()
    assert values(wide) == {(49, x, 0): arrays["a"][49, x] for x in range(80)} and {r.bytes for r in wide} == {640}
    assert window.where("x > 500").count() == 0 and scan_arrays(spark, f"file://{out}").where(F.col("path") == f"file://{out}/c.npy").select("path").distinct().count() == 1


def test_keys_and_broken_files(spark, folder, tmp_path):
    out, _ = folder
    assert scan_arrays(spark, f"file://{out}/s.npz", key="other").count() == 16
    for path, key in ((out / "s.npz", "none"), (out / "a.npy", "image")):
        with pytest.raises(Exception, match="no array|only archives"):
            scan_arrays(spark, f"file://{path}", key=key).count()
    np.savez(tmp_path / "two.npz", x=np.ones((2, 2)), y=np.ones((2, 2)))
    np.save(tmp_path / "line.npy", np.ones(5))
    (tmp_path / "broken.npy").write_bytes(b"no array")
    np.save(tmp_path / "good.npy", np.ones((2, 3)))
    with pytest.raises(Exception, match="broken.npy"):
        scan_arrays(spark, f"file://{tmp_path}").count()
    rows = scan_arrays(spark, f"file://{tmp_path}", broken="report").collect()
    issues = {r.path.rsplit("/", 1)[1]: r.issue for r in rows if r.issue}
    assert set(issues) == {"two.npz", "line.npy", "broken.npy"} and "several arrays" in issues["two.npz"] and "no image" in issues["line.npy"]
    assert sum(r.v is not None for r in rows) == 6
