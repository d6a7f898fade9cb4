"""DataFrame -> DataFrame operators; none of them runs a job."""
