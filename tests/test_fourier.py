"""Transforms and what is done in frequency space against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from imgq.operators import fourier
from imgq.operators.stencil import shapes

rng = np.random.default_rng(4)
A, B = rng.random((13, 10)), rng.random((6, 9))


def frame(spark, images):
    rows = [(k, y, x, float(v)) for k, image in images.items() for (y, x), v in np.ndenumerate(image)]
    return spark.createDataFrame(rows, "image_id string, y int, x int, v double").repartition(3)


def back(df, column="v"):
    out = {}
    for k in {r["image_id"] for r in df.select("image_id").collect()}:
        rows = df.where(F.col("image_id") == k).collect()
        image = np.zeros((max(r["y"] for r in rows) + 1, max(r["x"] for r in rows) + 1), dtype=complex)
        for r in rows:
            image[r["y"], r["x"]] = r[column] if column in r else complex(r["re"], r["im"])
        out[k] = image if "im" in df.columns else image.real
        assert len(rows) == image.size
    return out


@pytest.fixture(scope="module")
def pixels(spark):
    return frame(spark, {"a": A, "b": B}).cache()


def test_transforms_and_back(spark, pixels):
    whole, half = fourier.ufft2(fourier.complex_image(pixels)), fourier.urfft2(pixels)
    for k, image in (("a", A), ("b", B)):
        assert np.allclose(back(whole)[k], np.fft.fft2(image, norm="ortho"), atol=1e-9)
        assert np.allclose(back(half)[k], np.fft.rfft2(image, norm="ortho"), atol=1e-9)
        assert np.allclose(back(fourier.uirfft2(half, shapes(pixels)))[k], image, atol=1e-9)
        assert np.allclose(back(fourier.uifft2(whole))[k], image, atol=1e-9)
    norms = {r["image_id"]: r["norm"] for r in fourier.image_quad_norm(whole).collect()}
    assert np.isclose(norms["a"], (A**2).sum())
    assert np.isclose({r["image_id"]: r["norm"] for r in fourier.image_quad_norm(half, half=True).collect()}["b"], (B**2).sum())  # an odd width
    none = pixels.where("false")
    assert fourier.ufft2(fourier.complex_image(none)).count() == fourier.wiener(none, fourier.LAPLACIAN, 1.0).count() == 0


def test_null_counts_as_zero(spark):
    image = spark.createDataFrame([(1, 0, 0, None), (1, 0, 1, 2.0)], "image_id long, y int, x int, v double")
    assert np.allclose(back(fourier.ufft2(fourier.complex_image(image)))[1], np.fft.fft2([[0.0, 2.0]], norm="ortho"))


def padded(kernel, shape):
    out = np.zeros(shape)
    out[: kernel.shape[0], : kernel.shape[1]] = kernel
    return np.fft.rfft2(np.roll(out, [-(kernel.shape[0] // 2), -(kernel.shape[1] // 2)], (0, 1)))


def test_wiener_sharpens_as_the_formula(pixels):
    psf = np.array([[0.0, 0.2, 0.1], [0.1, 0.3, 0.1], [0.1, 0.1, 0.0]])
    got = back(fourier.wiener(pixels, psf.tolist(), 0.05, clip=False))
    for k, image in (("a", A), ("b", B)):
        h, r = padded(psf, image.shape), padded(np.array(fourier.LAPLACIAN), image.shape)
        want = np.fft.irfft2(np.conj(h) / (abs(h) ** 2 + 0.05 * abs(r) ** 2) * np.fft.rfft2(image), image.shape)
        assert np.allclose(got[k], want, atol=1e-9)
    assert abs(back(fourier.wiener(pixels, psf.tolist(), 1e-9))["a"]).max() <= 1


@pytest.mark.parametrize(("high", "squared", "npad"), [(True, True, 0), (False, False, 3)])
def test_butterworth(pixels, high, squared, npad):
    got = back(fourier.butterworth(pixels, 0.2, high, 3, squared, npad))
    for k, image in (("a", A), ("b", B)):
        wide = np.pad(image, npad, mode="edge")
        q = (np.fft.fftfreq(wide.shape[0])[:, None] / 0.2) ** 2 + (np.fft.fftfreq(wide.shape[1]) / 0.2) ** 2
        mask = 1 / (1 + q**3)
        mask = (1 - mask if high else mask) ** (1 if squared else 0.5)
        want = np.fft.ifft2(mask * np.fft.fft2(wide)).real
        assert np.allclose(got[k], want[npad : npad + image.shape[0], npad : npad + image.shape[1]], atol=1e-9)
    with pytest.raises(ValueError, match="cutoff"):
        fourier.butterworth(pixels, 0.7)


@pytest.mark.parametrize(("mode", "name"), [("edge", "edge"), ("reflect", "symmetric"), ("mirror", "reflect"), ("wrap", "wrap"), ("constant", "constant")])
def test_pad(pixels, mode, name):
    got = back(fourier.pad(pixels, 3, mode))
    assert np.array_equal(got["a"], np.pad(A, 3, mode=name)) and np.array_equal(got["b"], np.pad(B, 3, mode=name))


@pytest.mark.parametrize("mode", ["full", "same", "valid"])
def test_convolution(spark, pixels, mode):
    kernels = {"a": rng.random((4, 5)), "b": rng.random((3, 2))}
    got = back(fourier.fft_convolve(pixels, frame(spark, kernels), mode))
    for k, image in (("a", A), ("b", B)):
        kh, kw = kernels[k].shape
        full = np.zeros((image.shape[0] + kh - 1, image.shape[1] + kw - 1))
        for (i, j), v in np.ndenumerate(kernels[k]):
            full[i : i + image.shape[0], j : j + image.shape[1]] += v * image
        top, left = {"full": (0, 0), "same": ((kh - 1) // 2, (kw - 1) // 2), "valid": (kh - 1, kw - 1)}[mode]
        h, w = {"full": full.shape, "same": image.shape, "valid": (image.shape[0] - kh + 1, image.shape[1] - kw + 1)}[mode]
        assert np.allclose(got[k], full[top : top + h, left : left + w], atol=1e-9)


def shifted(image, dy, dx):
    ky, kx = np.fft.fftfreq(image.shape[0])[:, None], np.fft.fftfreq(image.shape[1])
    return np.fft.ifft2(np.fft.fft2(image) * np.exp(-2j * np.pi * (ky * dy + kx * dx))).real


def smooth(h, w):
    ky, kx = np.fft.fftfreq(h)[:, None], np.fft.fftfreq(w)
    return np.fft.ifft2(np.fft.fft2(rng.random((h, w))) * np.exp(-30 * (ky**2 + kx**2))).real + 1


@pytest.mark.parametrize("normalization", ["phase", None])
def test_planted_shifts_of_whole_places(spark, normalization):
    images = {"a": rng.random((20, 17)), "b": rng.random((16, 24))}
    moves = {"a": (-3, 5), "b": (7, -8)}
    moving = {k: np.roll(v, moves[k], (0, 1)) for k, v in images.items()}
    got = {r["image_id"]: r for r in fourier.phase_cross_correlation(frame(spark, images), frame(spark, moving), normalization=normalization).collect()}
    assert {k: (-r["shift_y"], -r["shift_x"]) for k, r in got.items()} == moves
    if normalization is None:
        assert all(r["error"] < 1e-6 and abs(r["phasediff"]) < 1e-9 for r in got.values())


def test_planted_shifts_between_places(spark):
    images = {"a": smooth(32, 28), "b": smooth(25, 40)}
    moves = {"a": (2.4, -1.3), "b": (-0.7, 3.2)}
    moving = {k: shifted(v, *moves[k]) for k, v in images.items()}
    got = {r["image_id"]: r for r in fourier.phase_cross_correlation(frame(spark, images), frame(spark, moving), upsample=10, normalization=None).collect()}
    for k, r in got.items():
        assert np.allclose((-r["shift_y"], -r["shift_x"]), moves[k], atol=0.051) and r["error"] < 0.05


def test_images_of_one_row_do_not_shift_that_way(spark):
    line = rng.random((1, 9))
    r = fourier.phase_cross_correlation(frame(spark, {"a": line}), frame(spark, {"a": np.roll(line, 2, 1)})).first()
    assert (r["shift_y"], r["shift_x"]) == (0.0, -2.0)
