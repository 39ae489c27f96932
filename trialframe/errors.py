"""What the library raises."""


class TrialframeError(Exception):
    """Base of all errors of this library."""


class ConfigError(TrialframeError):
    pass


class PlanError(TrialframeError):
    """A parameter space, expression or design that cannot be carried out."""


class PipelineInvalid(TrialframeError):
    """A dataflow graph that fails validation."""


class PortMismatch(PipelineInvalid):
    pass


class RunError(TrialframeError):
    """A block or partition failed."""


class ResourceError(TrialframeError):
    """Resources that the master cannot schedule."""


class ArtifactError(TrialframeError):
    pass


class ArtifactCorrupt(ArtifactError):
    pass


class CheckpointMismatch(TrialframeError):
    pass


class StateConflict(TrialframeError):
    """An illegal transition, or a version that another writer took."""


class Paused(TrialframeError):
    pass


class Cancelled(TrialframeError):
    pass
