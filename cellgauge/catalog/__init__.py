"""Every query by name, over the driver's tables bound to the network domain, with its oracle SQL."""
