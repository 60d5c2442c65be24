import itertools

import pytest

from pathloom.functions.grammar import representable, segments


def _programs(depth):
    """Every program of a depth as ((start, size, op), ...) with its path."""

    def rec(layer, seg, out):
        if layer == depth:
            yield tuple(seg), tuple(out)
            return
        for z in range(1, min(4, depth - layer) + 1):
            for o in (0, 1, 2):
                yield from rec(layer + z, [*seg, (layer, z, o)], out + list(range(layer, layer + z)) * o)

    return list(rec(0, [], []))


def _key(seg):
    return (len(seg), sum(o == 0 for _, _, o in seg), -sum(o == 2 for _, _, o in seg), [-z for _, z, _ in seg])


@pytest.mark.parametrize("depth", [1, 2, 3, 4, 5])
def test_canonical_program_is_the_least_of_all(depth):
    best = {}
    for seg, path in _programs(depth):
        if path not in best or _key(seg) < _key(best[path]):
            best[path] = seg
    for path, seg in best.items():
        assert segments(path, depth) == seg
        assert representable(path, depth)


def test_other_paths_are_refused():
    good = {path for _, path in _programs(3)}
    for n in range(5):
        for path in itertools.product(range(3), repeat=n):
            assert representable(path, 3) == (path in good) == (segments(path, 3) is not None)
    assert segments((0, 0, 0, 1), 2) is None
    assert segments((1, 0, 2, 3), 4) is None
    assert segments((), 4) == ((0, 4, 0),)
