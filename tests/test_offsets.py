import pytest

from voxloom.functions.offsets import Kernel, cross, cube, cube_first_axis_slowest, kernel_index


def test_cube_runs_first_axis_fastest_and_is_centred_if_odd():
    assert cube(3, 2)[:4] == [(-1, -1), (0, -1), (1, -1), (-1, 0)]
    assert cube(2, 3)[:3] == [(0, 0, 0), (1, 0, 0), (0, 1, 0)]


def test_cross_starts_at_the_centre():
    assert cross(5, 2) == [(0, 0), (1, 0), (2, 0), (-2, 0), (-1, 0), (0, 1), (0, 2), (0, -2), (0, -1)]
    with pytest.raises(ValueError):
        cross(2, 3)


def test_octree_slots_run_first_axis_slowest():
    assert cube_first_axis_slowest(3, 3)[kernel_index((1, 0, -1), 3)] == (1, 0, -1)
    assert kernel_index((-1, -1, 0), 3) == 1


def test_kernel_checks():
    assert Kernel(3, 2).taps(1) == [(-2,), (0,), (2,)]
    for bad in (Kernel(shape="custom"), Kernel(shape="ring")):
        with pytest.raises(ValueError):
            bad.taps(2)
    with pytest.raises(ValueError):
        Kernel((3, 3)).taps(3)


def test_entry_imports_without_a_session():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 150"
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0
