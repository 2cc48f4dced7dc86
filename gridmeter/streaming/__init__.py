from gridmeter.streaming.hourly import stream_hourly

__all__ = ["stream_hourly"]
