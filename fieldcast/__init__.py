"""fieldcast: player-projection analytics as lazy Spark DataFrame operators.

Every operator is a function ``DataFrame(s) -> DataFrame`` with keyword
parameters; nothing is collected to the driver except scalars and tiny
k x k model matrices.
"""

__version__ = "0.1.0"
