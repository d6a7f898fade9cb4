"""Writers and checks (SNK-01..SNK-07): the only functions that run jobs."""
