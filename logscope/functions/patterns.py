"""Fixed values that must equal the reference analysis for identical results.

Fixed values (do not edit): the five Common Log Format patterns, the
validity patterns, month abbreviations, weekday names, hour ranges and
status class labels, stated in their natural order.
"""

# Field patterns for Common Log Format lines.
HOST_PATTERN = r"(^\S+\.[\S+\.]+\S+)\s"
TIMESTAMP_PATTERN = r"\[(\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2} -\d{4})]"
REQUEST_PATTERN = r"\"(\S+)\s(\S+)\s*(\S*)\""
STATUS_PATTERN = r"\s(\d{3})\s"
CONTENT_SIZE_PATTERN = r"\s(\d+)$"
# The data-quality check for raw lines without a size.
SIZE_LINE_PATTERN = r"\s\d+$"

# A method or protocol is invalid when empty or matching these.
INVALID_METHOD_PATTERN = r"[^A-Za-z]"
INVALID_PROTOCOL_PATTERN = r"[^HTTP/\.\d]"

# Month abbreviations, January first.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun",
          "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# Weekday labels, Monday first.
WEEKDAY_ABBR = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
WEEKDAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday",
                 "Friday", "Saturday", "Sunday"]

# Three-hour ranges (hour 0 has none), as (label, first, last).
HOUR_RANGES = [("1-3", 1, 3), ("4-6", 4, 6), ("7-9", 7, 9), ("10-12", 10, 12),
               ("13-15", 13, 15), ("16-18", 16, 18), ("19-21", 19, 21),
               ("22-24", 22, 24)]

# Five-way status categories (service and page 1), half-open.
STATUS_CATEGORIES = [("2xx (Success)", 200, 300),
                     ("3xx (Redirection)", 300, 400),
                     ("4xx (Client Error)", 400, 500),
                     ("5xx (Server Error)", 500, 600)]
STATUS_OTHER = "Other"

# Page-2 status classes (no 5xx class there), half-open.
STATUS_CODES = [("2xx", 200, 300), ("3xx", 300, 400), ("4xx", 400, 500)]

# Methods shown in the hourly pivot.
PIVOT_METHODS = ["GET", "HEAD", "POST"]

# Day-profile labels and the 1.5x-of-mean rule order.
PROFILE_HIGH_TRAFFIC = "High Traffic Days"
PROFILE_HIGH_USER = "High User Days"
PROFILE_PEAK = "Peak Activity Days"
PROFILE_REGULAR = "Regular Days"
PROFILE_FACTOR = 1.5
