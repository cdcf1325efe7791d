"""Fill, return and leverage formulas as column expressions."""

from pyspark.sql import functions as F

SLIP = 0.0002
FEE = 0.0001


def entry_fill(open_px, direction, slip=SLIP):
    return open_px * (1 + F.lit(slip) * direction)


def net_return(entry, exit_px, direction, fee=FEE):
    return direction * (exit_px - entry) / entry - 2 * fee


def levered(ret, lev, rate, hold_s, floor_s=300, year_s=365 * 86400):
    """Levered return less financing on the borrowed part; the holding time has a floor."""
    return lev * ret - (lev - 1) * rate * F.greatest(hold_s, F.lit(floor_s)) / year_s


def margin_call_move(maint, lev):
    """Price move at which equity meets the maintenance margin; NULL without leverage."""
    return F.when(lev > 1, (maint * lev - 1) / ((1 - maint) * lev))


def true_range(high, low, prev_close):
    return F.greatest(high - low, F.abs(high - prev_close), F.abs(low - prev_close))


def signal_direction(ret, trigger):
    return F.when(ret >= trigger, 1).when(ret <= -trigger, -1).otherwise(0)


def deadband(ret, trigger):
    """+1/-1 by sign once |ret| reaches the trigger, else NULL."""
    return F.when(F.abs(ret) >= trigger, F.when(ret > 0, 1).otherwise(-1))
