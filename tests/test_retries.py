import os
import subprocess
import sys

from places import ROOT


def test_failed_tasks_leave_results_whole(folder):
    run = subprocess.run(
        [sys.executable, f"{ROOT}/tests/retried_job.py", folder],
        env={**os.environ, "PYTHONPATH": f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"},
        capture_output=True,
        text=True,
        timeout=300,
    )
    assert run.returncode == 0, run.stderr[-3000:]
