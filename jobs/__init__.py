"""Jobs that run by themselves: one module each, with a function that takes a session, a command line and a small config file."""
