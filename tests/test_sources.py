"""Array files by blocks of rows, against numpy."""

import numpy as np
import pytest

from cellatlas.sources import arrays, catalog


@pytest.fixture(scope="module")
def formats(spark):
    arrays.register(spark)
    return spark.read


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(2)
    return np.where(rng.random((101, 13)) < 0.2, rng.integers(1, 9, (101, 13)), 0).astype(np.float32)


def compressed_rows(x):
    row, column = np.nonzero(x)
    return {"data": x[row, column], "indices": column.astype(np.int32), "indptr": np.concatenate([[0], np.cumsum((x != 0).sum(1))]).astype(np.int32)}


def cells(df, shape):
    out = np.zeros(shape, np.float32)
    for r in df.collect():
        assert out[r["cell"], r["gene"]] == 0 != r["value"]
        out[r["cell"], r["gene"]] = r["value"]
    return out


@pytest.mark.parametrize("kind", ["dense", "csr", "csc"])
@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_matrix(formats, matrix, tmp_path, kind, save):
    path = str(tmp_path / "m.npz")
    save(path, **({"X": matrix} if kind == "dense" else compressed_rows(matrix if kind == "csr" else matrix.T) | {"shape": np.array(matrix.shape), "format": np.array([kind.encode()])}))
    df = formats.format("atlas_matrix").option("path", path).option("block", 10).load()
    assert df.rdd.getNumPartitions() == (2 if kind == "csc" else 11)
    assert (cells(df, matrix.shape) == matrix).all()


def test_vectors(formats, tmp_path):
    x = np.random.default_rng(1).normal(size=(57, 4)).astype(np.float32)
    path = str(tmp_path / "v.npz")
    np.savez(path, orig_ids=np.array([f"c{i}" for i in range(57)]), transcriptome_embeds=x, labels=np.array([b"one", b"two", b"three"])[np.arange(57) % 3])
    df = formats.format("atlas_vectors").option("path", path).option("block", 20).load()
    assert df.rdd.getNumPartitions() == 3
    rows = {r["id"]: r for r in df.collect()}
    assert len(rows) == 57 and all(np.allclose(rows[f"c{i}"]["vec"], x[i]) and rows[f"c{i}"]["label"] == ["one", "two", "three"][i % 3] for i in range(57))
    np.savez(path, ids=np.arange(3), v=x[:3])
    plain = formats.format("atlas_vectors").option("path", path).option("ids", "ids").option("vectors", "v").load()
    assert plain.columns == ["id", "vec"] and sorted(r["id"] for r in plain.collect()) == ["0", "1", "2"]


def test_atlas(spark, matrix, tmp_path):
    """Cells, genes and values of one archive; symbols are mapped and made unique, codes are laid out."""
    path = str(tmp_path / "atlas.npz")
    symbols = np.array(["A", "B", "A", *[f"S{i}" for i in range(10)]])
    obs = {"obs/_index": np.array([f"cell{i}" for i in range(101)]), "obs/depth": np.arange(101.0), "obs/kind/codes": (np.arange(101) % 3 - 1).astype(np.int8), "obs/kind/categories": np.array(["x", "y"])}
    var = {"var/_index": np.array([f"ENSG{i:05d}.1" for i in range(13)]), "var/feature_name": symbols}
    np.savez_compressed(path, **compressed_rows(matrix), format=np.array([b"csr"]), **obs, **var)
    found = catalog.read_atlas(spark, path, block=20)
    cells = {r["cell_id"]: (r["depth"], r["kind"]) for r in found["cells"].collect()}
    assert len(cells) == 101 and cells["cell0"] == (0.0, None) and cells["cell1"] == (1.0, "x") and cells["cell2"] == (2.0, "y")
    unique = [r["symbol"] for r in found["genes"].orderBy("gene_idx").collect()]
    assert unique[:3] == ["A", "B", "A-1"]
    expr = {(r["cell_id"], r["gene"]): r["value"] for r in found["expr"].collect()}
    assert expr == {(f"cell{i}", unique[j]): matrix[i, j] for i, j in zip(*np.nonzero(matrix))}


def test_h5ad_without_h5py(formats, tmp_path):
    (tmp_path / "x.h5ad").write_bytes(b"")
    with pytest.raises(Exception, match="h5py is needed"):
        formats.format("atlas_matrix").option("path", str(tmp_path / "x.h5ad")).load().collect()


def test_odd_files(formats, tmp_path):
    path = str(tmp_path / "none.npz")
    np.savez(path, X=np.zeros((0, 3), np.float32))
    assert formats.format("atlas_matrix").option("path", path).load().collect() == []
    np.savez(path, **compressed_rows(np.zeros((4, 3), np.float32)))
    assert formats.format("atlas_matrix").option("path", path).load().collect() == []
    np.savez(path, X=np.asfortranarray(np.ones((4, 3), np.float32)))
    with pytest.raises(Exception, match="by column"):
        formats.format("atlas_matrix").option("path", path).load().collect()
