"""Projects taken through their stages, with what is done remembered."""

from collections.abc import Callable

from pyspark.sql import DataFrame

from seamline import fixed_values as fixed
from seamline.operators.intake import projects_before_stage
from seamline.session import written
from seamline.sources.stores import StageStates


def run_stages(projects: DataFrame, states: StageStates, stages: list[tuple[str, Callable[[DataFrame], None]]], run: str) -> str | None:
    """Do each stage (a name of `fixed_values.STAGES` and its work) for the projects that have not passed it; None if all went well.

    A stage whose work fails is not noted, the stages after it wait, and its name is returned with the error. Run again, each project
    goes on from the stage it stopped at; work that stores its results as it goes (`SegmentStore.append_new`) loses none of them.
    """
    for name, work in stages:
        number = fixed.STAGES[name]
        pending = written(projects_before_stage(projects, states.load(), number).select("project"), "pending")
        try:
            work(pending)
        except Exception as error:  # whatever it was, the stages passed so far are noted
            return f"{name}: {error}"
        states.record(pending, number, run)
    return None
