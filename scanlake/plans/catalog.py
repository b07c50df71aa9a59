"""All queries of the engine: importing this fills the registry."""

from scanlake.plans import clouds, decoding, ordered, perception, radar_packets, radars, sensor_info, stateful, streams  # noqa: F401
from scanlake.plans.registry import ORACLES, QUERIES  # noqa: F401
