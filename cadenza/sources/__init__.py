"""Sources and sinks of signals: header files, packed blocks, generators, and combinations of several inputs."""
