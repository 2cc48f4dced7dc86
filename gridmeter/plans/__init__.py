from gridmeter.plans.stages import Stages, build_stages

__all__ = ["Stages", "build_stages"]
